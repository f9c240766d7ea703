"""SimHash near-duplicates linked through BK-trees.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's 3-word shingles. Two fingerprints
link at RADIUS or fewer differing bits.

Rows first collapse to distinct fingerprints. By the pigeonhole principle, two fingerprints within
radius 3 agree on at least one of four 16-bit blocks, so each distinct fingerprint goes to four shards
(block number, block value) and every link lies whole in some shard. A shard that holds more than
SHARD_MOST fingerprints is split the same way again on its other bits, up to LEVELS times in all: then its
fingerprints have 45 bits in common, so that they can't be more than 2**19. In each shard a BK-tree (children keyed by integer
Hamming distance to the parent) is built and searched, following only edges within the radius. Trees
travel to their queries by shuffle rather than broadcast, as a broadcast would gather all fingerprints
on the driver. A shard returns its links as a forest over its own members, never all pairs.

Components come from alternating large-star and small-star rounds on the links alone, as DataFrame
aggregates, checkpointed each round. Once no more than FEW_LINKS are left (they are counted first) one task
finishes them: rounds of shuffles would cost more than those links do.

A null or empty text, or one of spaces only, has fingerprint zero and links like any other. Repeated
rows are members like any other; a row with a null doc_id is a member, but never names a component
unless all ids in it are null. Texts of any length count whole. doc_id is a number; other columns, whatever their
names, are not read and stay as they are in representatives(). No documents: no rows.

representatives(), which keeps one document of each group of near copies, needs more than the radius of one fingerprint gives:
it takes several fingerprints of 2-word shingles, each of which finds its links by trees in shards like those above, at a
larger radius. Such links only propose groups: within one, in the order of doc_id, a document goes if its Jaccard index with
one that stays is 0.8 or more, in sets of five-word shingles (a text of fewer words is one shingle). So every document that
goes is a near copy of one that stays, and none goes on an estimate alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm import words
from palisade.llm.common import named, numbered, partitions, prepare, record, renamed, slices, texts

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Distinct fingerprints of a shard beyond which it is split again.
SHARD_MOST = 4096
#: Splits of a shard at most; links that one task makes into components at most (16 bytes each).
LEVELS, FEW_LINKS = 4, 1_000_000
#: Pairs of a query and a node that are looked at together.
FRONTIER = 200_000


def fingerprint_of(text: bytes, shingle: int = SHINGLE) -> int:
    """Lower-cases A-Z only, takes runs of other than ASCII white space as words."""
    w = text.lower().split()
    if not w:
        return 0
    h = xxhash.xxh64_intdigest
    if len(w) <= shingle:
        return h(b" ".join(w), SEED)
    parts = map(b" ".join, zip(*(w[k:] for k in range(shingle))))
    hashes = np.fromiter([h(x, SEED) for x in parts], dtype="<u8", count=len(w) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long), one row per row of docs."""
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = np.array([fingerprint_of(x) for x in texts(batch)], dtype=np.uint64).view(np.int64)
            yield record(schema, batch.column("doc_id").cast(pa.int64()), fp)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


class Forest:
    """BK-trees of several groups at once, built level by level on arrays.

    In each node the first member is the pivot; the others go to the child under their distance to it."""

    def __init__(self, fp: np.ndarray, group: np.ndarray) -> None:
        """fp: distinct within a group; group: sorted group numbers from 0."""
        self.fp = fp
        member = np.arange(len(fp))
        node = group.astype(np.int64)
        pivots, keys, base = [], [], 0
        parent_key = np.zeros(0, np.int64)
        while len(member):
            first = np.concatenate([[True], node[1:] != node[:-1]])
            number = np.cumsum(first) - 1
            pivot = member[first]
            pivots.append(pivot)
            keys.append(parent_key if base else np.full(len(pivot), -1, np.int64))
            rest = ~first
            d = np.bitwise_count(fp[member[rest]] ^ fp[pivot[number[rest]]]).astype(np.int64)
            key = (number[rest] + base) * 128 + d
            order = np.argsort(key, kind="stable")
            member, node = member[rest][order], key[order]
            parent_key = node[np.concatenate([[True], node[1:] != node[:-1]])] if len(node) else node
            base += len(pivot)
        self.pivot = np.concatenate(pivots) if pivots else np.zeros(0, np.int64)
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.roots = int((keys == -1).sum())
        self.keys = keys[self.roots :]  # ascending: levels follow each other and number their nodes in order

    def links(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, member) within the radius, for queries that start at given roots."""
        # depth first over parts of the frontier, so that memory doesn't grow with groups that lie close together
        todo = [(queries, roots)]
        while todo:
            query, node = todo.pop()
            if len(query) > FRONTIER:
                todo += [(query[k : k + FRONTIER], node[k : k + FRONTIER]) for k in range(0, len(query), FRONTIER)]
                continue
            d = np.bitwise_count(self.fp[query] ^ self.fp[self.pivot[node]]).astype(np.int64)
            near = d <= radius
            yield query[near], self.pivot[node[near]]
            next_q, next_n = [], []
            for e in range(-radius, radius + 1):
                key = np.where(d + e > 0, node * 128 + d + e, -1)
                at = np.searchsorted(self.keys, key)
                ok = at < len(self.keys)
                ok[ok] = self.keys[at[ok]] == key[ok]
                next_q.append(query[ok])
                next_n.append(at[ok] + self.roots)
            query, node = np.concatenate(next_q), np.concatenate(next_n)
            if len(query):
                todo.append((query, node))


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each member's component."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        np.minimum.at(new, low[a], m)
        np.minimum.at(new, low[b], m)
        new = new[new]
        if np.array_equal(new, low):
            return low
        low = new


def forest_links(fp: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between members of a group as a forest: each member with the root of its component in the group."""
    trees, n = Forest(fp, group), len(fp)
    low = np.arange(n)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def settle() -> np.ndarray:
        a, b = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        held.clear()
        return roots_of(n, np.concatenate([a, np.arange(n)]), np.concatenate([b, low]))

    for at in range(0, n, 2048):
        query = np.arange(at, min(at + 2048, n))
        for q, m in trees.links(query, group[query].astype(np.int64), radius):
            other = q > m
            if other.any():
                held.append((q[other], m[other]))
        if sum(len(q) for q, _ in held) > 2_000_000:
            low = settle()
    if held:
        low = settle()
    linked = low != np.arange(n)
    return np.nonzero(linked)[0], low[linked]


def _cut(free: int, parts: int) -> list[int]:
    """Masks that split the free bits into so many blocks."""
    bits = [i for i in range(64) if free >> i & 1]
    return [sum(1 << i for i in bits[k * len(bits) // parts : (k + 1) * len(bits) // parts]) for k in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shards(distinct: DataFrame, radius: int = RADIUS, most: int = SHARD_MOST, levels: int = LEVELS) -> DataFrame:
    """fp and shard (a string key): each fingerprint under each block of its bits; shards with more than
    `most` members are split again by blocks of the other bits."""

    rows = distinct.select("fp", F.lit("").alias("shard"), F.lit(0).alias("mask"))
    free, done = [(1 << 64) - 1], []
    for k in range(levels):
        rows, free = _split(rows, free, radius)
        if k + 1 == levels:
            break
        # they stay a frame, as their number grows with the input; Spark picks the join by their size
        hot = rows.groupBy("shard").count().where(F.col("count") > most).select("shard", F.lit(True).alias("hot")).checkpoint()
        if hot.isEmpty():
            break
        marked = rows.join(hot, "shard", "left")
        done.append(marked.where(F.col("hot").isNull()).select("fp", "shard"))
        rows = marked.where("hot").select("fp", "shard", "mask")
    out = rows.select("fp", "shard")
    for x in done:
        out = out.unionByName(x)
    return out


def _split(rows: DataFrame, free: list[int], radius: int) -> tuple[DataFrame, list[int]]:
    """rows (fp, shard, mask) under each block of the bits that free[mask] leaves; what each block leaves."""
    parts = radius + 1
    blocks = [b for bits in free for b in _cut(bits, parts)]
    entries = F.array(
        *(F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(b))).alias("value")) for i, b in enumerate(blocks))
    )
    out = rows.select("fp", "shard", F.explode(F.slice(entries, F.col("mask") * parts + 1, parts)).alias("e"))
    shard = F.concat_ws("/", "shard", F.col("e.mask"), F.col("e.value"))
    left = [bits & ~b for bits in free for b in _cut(bits, parts)]
    return out.select("fp", shard.alias("shard"), F.col("e.mask").alias("mask")), left


def links(distinct: DataFrame, n: int, radius: int = RADIUS, most: int = SHARD_MOST, levels: int = LEVELS) -> DataFrame:
    """a and b: fingerprints that belong together, enough of the links to connect all that link. Shards are dealt
    over n partitions."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # whole shards at a time: rows come sorted by shard
        def groups() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            held: list[tuple[np.ndarray, np.ndarray]] = []
            size = 0
            for b in batches:
                if not b.num_rows:
                    continue
                held.append((b.column("fp").to_numpy(), b.column("key").to_numpy()))
                size += b.num_rows
                if size > 20000 and held[0][1][0] != held[-1][1][-1]:
                    fp, key = map(np.concatenate, zip(*held))
                    last = int(np.searchsorted(key, key[-1]))
                    yield fp[:last], key[:last]
                    held, size = [(fp[last:], key[last:])], len(key) - last
            if held:
                yield tuple(map(np.concatenate, zip(*held)))

        for fp, key in groups():
            _, group, sizes = np.unique(key, return_inverse=True, return_counts=True)
            several = sizes[group] > 1
            if not several.any():
                continue
            fp, group = fp[several].view(np.uint64), np.unique(group[several], return_inverse=True)[1]
            a, b = forest_links(fp, group, radius)
            yield record(schema, fp[a].view(np.int64), fp[b].view(np.int64))

    # two shards under one 64-bit key merely make one larger tree
    keyed = shards(distinct, radius, most, levels).select("fp", F.xxhash64("shard").alias("key"))
    return keyed.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long").distinct()


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fp and root of all that the links (a, b) of one task connect."""
    schema = pa.schema([("fp", pa.int64()), ("root", pa.int64())])
    held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if held:
        a, b = map(np.concatenate, zip(*held))
        fp, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = fp[roots_of(len(fp), at[: len(a)], at[len(a) :])]
        for k in range(0, len(fp), 50_000):
            yield record(schema, fp[k : k + 50_000], root[k : k + 50_000])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """fp and root for all that have links, by large-star and small-star rounds until few are left or nothing
    changes."""
    prepare(edges.sparkSession)
    state = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    seen = None
    for _ in range(most_rounds):
        if state.count() <= FEW_LINKS:
            return state.coalesce(1).mapInArrow(_settled, "fp long, root long")
        # large-star: larger neighbours go to the smallest of one's neighbourhood. Minima are aggregates
        # (combined before the shuffle) and a hub meets its minimum in a join, which AQE splits.
        both = state.select("a", "b").unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        # small-star: smaller neighbours and oneself go to the smallest neighbour
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        state = small.where("a <> b").distinct().checkpoint()
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return state.select(F.col("a").alias("fp"), F.col("b").alias("root"))
        seen = now
    raise RuntimeError("components did not settle")


def classes(docs: DataFrame, radius: int = RADIUS, most: int = SHARD_MOST) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable by links), one row per row of docs."""
    own = fingerprints(docs).checkpoint()
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp"), partitions(docs, 1 << 30), radius, most))
    named = distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    # joins to rows on fp: copies in their thousands meet one row of the other side, which AQE splits
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return own.join(ids, "fp").select("doc_id", "fp", "component_id")


def hex_of(column):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return classes(docs).select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")


#: What representatives() goes by: words of a shingle, fingerprints of a text, differing bits of one of them at most, splits of
#: a shard. One fingerprint at a radius that pigeonholes bear finds few of the pairs at a similarity of 0.8 (the bits that
#: differ scatter), several find nearly all.
NEAR_SHINGLE, KINDS, NEAR_RADIUS, NEAR_LEVELS = 2, 3, 5, 2
#: Words of a shingle by which proposed copies are verified; members of a group that are judged in one task in the first round,
#: and those that are compared with the leaders among them in one.
VERIFIED, HEADS, SALTED = 5, 64, 2000
#: Rounds judge so many times the members of the one before, up to so many: a group whose members are all unlike is over in few.
MORE, MOST_HEADS = 4, 1024
#: Bits by which sets are compared before their members are; bytes of texts whose words are hashed at a time.
BITS, WORDS = 12, 1 << 20
#: The steps that make one hash into several (those of a common 64-bit mixer).
STEP, MIX_ONE, MIX_TWO = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def sketches_of(texts: list[bytes], shingle: int = NEAR_SHINGLE, kinds: int = KINDS) -> np.ndarray:
    """(texts, kinds) fingerprints of texts, each from a text's different shingles' hashes mixed anew; zeros for one without
    words."""
    hashes, bounds = sets_of(texts, shingle)
    out = np.zeros((len(texts), kinds), dtype=np.uint64)
    for k in range(kinds):
        x = hashes + np.uint64((k + 1) * STEP % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_ONE)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_TWO)
        out[:, k] = words.majorities(x ^ (x >> np.uint64(31)), bounds)
    return out


def sets_of(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes, ascending, of the runs of `size` words of each text, text after text, and where each text's begin:
    each run once, so that very frequent ones don't decide alone. None for a text without words."""
    hashes, bounds = words.shingles(texts, size, SEED)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        hashes[a:b].sort()
    first = np.ones(len(hashes), dtype=bool)
    first[1:] = hashes[1:] != hashes[:-1]
    first[bounds[:-1][np.diff(bounds) > 0]] = True
    return hashes[first], np.concatenate([[0], np.cumsum(first)])[bounds]


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard index of 0.8 or more; two empty ones have."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def _sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    column = batch.column("shingles")
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return np.split(column.flatten().to_numpy(), ends[:-1]) if len(ends) else []


_OPEN = "root long, node long, leader long, shingles array<long>"
_OPEN_ARROW = pa.schema([("root", pa.int64()), ("node", pa.int64()), ("leader", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def _bits(own: np.ndarray) -> np.ndarray:
    """One bit for each place that a set's hashes have in 2**BITS, as 64-bit words."""
    seen = np.zeros(1 << BITS, dtype=np.uint8)
    seen[own.view(np.uint64) >> np.uint64(64 - BITS)] = 1
    return np.packbits(seen).view(np.uint64)


class _Leaders:
    """Leaders of a group in the order in which they came."""

    def __init__(self) -> None:
        self.sets: list[np.ndarray] = []
        self.nodes: list[int] = []
        self.bits, self.sizes = np.zeros((16, (1 << BITS) // 64), dtype=np.uint64), np.zeros(16, dtype=np.int64)

    def add(self, node: int, own: np.ndarray) -> None:
        n = len(self.sets)
        if n == len(self.sizes):
            self.bits, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.bits, self.sizes))
        self.bits[n], self.sizes[n] = _bits(own), len(own)
        self.sets.append(own.copy())
        self.nodes.append(node)

    def like(self, own: np.ndarray) -> int | None:
        """The first leader that a set is like. Hashes at places that a leader's have not are none of its, which bounds what
        both have; only those that the bound lets through are compared."""
        n = len(self.sets)
        alone = np.bitwise_count(_bits(own) & ~self.bits[:n]).sum(axis=1, dtype=np.int64)
        near = np.nonzero(9 * (len(own) - alone) >= 4 * (len(own) + self.sizes[:n]))[0]
        return next((self.nodes[k] for k in near.tolist() if alike(own, self.sets[k])), None)


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row (root, _s, leads, node, shingles), in order, with the first leader of its group (root, _s) that it is like.
    A row whose `leads` is 0 is a leader that stays one and isn't given back, 1 becomes one if it is like none, 2 doesn't."""
    group, leaders = None, _Leaders()
    for batch in slices(batches):
        out = []
        for root, s, leads, node, own in zip(*(batch.column(c).to_pylist() for c in ("root", "_s", "leads", "node")), _sets(batch)):
            if (root, s) != group:
                group, leaders = (root, s), _Leaders()
            if leads == 0:
                leaders.add(node, own)
                continue
            found = leaders.like(own)
            if found is None and leads == 1:
                leaders.add(found := node, own)
            # a row that isn't gone needs its shingles again
            out.append((root, node, found, own if found in (None, node) else None))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [[]] * 4, _OPEN_ARROW)], schema=_OPEN_ARROW)


def verified(members: DataFrame, n: int, heads: int = HEADS, salted: int = SALTED) -> DataFrame:
    """node and leader of all members (root, node, shingles of proposed groups) that are like one with a smaller node that stays.

    In rounds: the first `heads` undecided members of each group are judged in one task, then all others are compared with those
    of them that stay, `salted` members of a group or so to a task. Most groups need no second round; the next rounds judge MORE
    times as many, as each moves and writes all that is left. A task holds no more than MOST_HEADS leaders (or `heads`), whatever
    the group's size."""
    rows, gone = members, []
    while not rows.isEmpty():
        first = rows.withColumn("_k", F.row_number().over(Window.partitionBy("root").orderBy("node"))).where(F.col("_k") <= heads)
        first = first.select("root", F.lit(0).alias("_s"), F.lit(1).alias("leads"), "node", "shingles")
        led = first.repartition(n, "root").sortWithinPartitions("root", "node").mapInArrow(_led, _OPEN).checkpoint()
        gone.append(led.where("leader <> node"))
        rest = rows.join(led.select("node"), "node", "left_anti")
        # copies of leaders and parts of a group by its size, so that a large group is many tasks' work
        parts = rest.groupBy("root").agg(F.ceil(F.count("*") / salted).cast("int").alias("_n"))
        asked = rest.join(parts, "root").select("root", F.pmod(F.hash("node"), "_n").alias("_s"), F.lit(2).alias("leads"), "node", "shingles")
        leaders = led.where("leader = node").join(parts, "root")
        leaders = leaders.select("root", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_s"), F.lit(0).alias("leads"), "node", "shingles")
        both = asked.unionByName(leaders).repartition(n, "root", "_s").sortWithinPartitions("root", "_s", "leads", "node")
        compared = both.mapInArrow(_led, _OPEN).checkpoint()
        gone.append(compared.where("leader IS NOT NULL"))
        rows, heads = compared.where("leader IS NULL").select("root", "node", "shingles"), max(heads, min(heads * MORE, MOST_HEADS))
    out = members.select("node", F.col("node").alias("leader")).limit(0)
    for x in gone:
        out = out.unionByName(x.select("node", "leader"))
    return out


def near_copies(docs: DataFrame, radius: int = NEAR_RADIUS, most: int = SHARD_MOST, heads: int = HEADS, salted: int = SALTED) -> DataFrame:
    """doc_id and root of the rows (of unique doc_ids) that are near copies of one with a smaller doc_id, root, that stays.
    Texts are compared if a chain of links leads from one to the other; they link if one of their fingerprints differs in no more
    than radius bits. Texts of the same words, but for the case of A-Z, are one and not compared."""
    prepare(docs.sparkSession)
    names, same = [f"f{k}" for k in range(KINDS)], ["h0", "h1"]
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in names + same)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, WORDS):
            held = texts(batch)
            fp = sketches_of(held).view(np.int64)
            plain = b"".join(xxhash.xxh3_128_digest(b" ".join(x.lower().split())) for x in held)
            yield record(schema, batch.column("doc_id").cast(pa.int64()), *fp.T.copy(), *np.frombuffer(plain, "<i8").reshape(-1, 2).T.copy())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("root", pa.int64()), ("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])
        for batch in slices(batches, WORDS):
            own, bounds = sets_of(texts(batch), VERIFIED)
            lists = pa.ListArray.from_arrays(bounds.astype(np.int32), own.view(np.int64))
            yield record(kinds, batch.column("root"), batch.column("node"), lists)

    own = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names + same)).checkpoint()
    # texts of the same words are one node, named by its smallest id
    nodes = own.groupBy(*same).agg(F.min("doc_id").alias("node"), *(F.first(n).alias(n) for n in names)).checkpoint()
    n, edges = partitions(docs, 1 << 30), None
    for name in names:
        first = nodes.groupBy(F.col(name).alias("fp")).agg(F.min("node").alias("node"))
        equal = nodes.select(F.col(name).alias("fp"), F.col("node").alias("a")).join(first.withColumnRenamed("node", "b"), "fp").select("a", "b")
        near = links(first.select("fp"), n, radius, most, NEAR_LEVELS)
        near = near.join(first.select(F.col("fp").alias("a"), F.col("node").alias("_a")), "a").join(first.select(F.col("fp").alias("b"), F.col("node").alias("_b")), "b")
        found = equal.unionByName(near.select(F.col("_a").alias("a"), F.col("_b").alias("b")))
        edges = found if edges is None else edges.unionByName(found)
    # a group's root is one of its members, whether or not it has a row of its own
    proposed = components(edges).select(F.col("fp").alias("node"), "root")
    proposed = proposed.unionByName(proposed.select(F.col("root").alias("node"), "root")).distinct()
    members = docs.select(F.col("doc_id").alias("node"), "text").join(proposed, "node").mapInArrow(sets, "root long, node long, shingles array<long>")
    gone = verified(members.checkpoint(), n, heads, salted)
    copies = own.join(nodes.select(*same, "node"), same).join(gone, "node", "left")
    return copies.select("doc_id", F.coalesce("leader", "node").alias("root")).where("doc_id <> root")


def representatives(docs: DataFrame) -> DataFrame:
    """docs, with all columns, without the near copies of rows that stay: of near copies the first by doc_id stays, nulls first,
    then by text."""
    held = numbered(renamed(docs), "text", *(f"_{k}" for k in range(len(docs.columns) - 2)))
    gone = near_copies(held.select(F.col("rid").alias("doc_id"), "text")).select(F.col("doc_id").alias("rid"))
    return named(held.join(gone, "rid", "left_anti"), docs)
