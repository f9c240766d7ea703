"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

Vectors become integers, floor(1024 x) by component. Each shard of candidates is indexed by dimension: the
postings of a dimension are its vectors in order of their component (the impact), cut into segments of one
quantised impact (a multiple of STEP). A query processes segments of all dimensions by descending quantised
contribution |q_d * impact|, one level of contributions after another, adding the segment's contribution to the accumulators of its
postings. After each level, what is still unread can change a score by no more than a proven amount: the
largest unread contributions of all dimensions, and what quantising has left off. A candidate whose upper
bound is under the k-th lower bound is out; once few enough are left (or nothing is unread) those are scored
exactly. The k-th best exact score so far of the query, from the shards before, counts as a lower bound too.
Nothing is approximate: without proof, reading goes on to the end.

Queries are a stated set, met by the candidates in blocks of BLOCK components at most: a block is on the driver
and broadcast by itself, and let go before the next, so both have a bound whatever the number of queries. Of
several blocks each goes over all candidates, which are dealt once. A task returns its k best of each query; the
final ranks come from a window over those.

All vectors take part but those that are null or hold null or non-finite components. Components are doubles with
whole values, which are exact; vectors of like magnitude share an index. Scores are summed exactly: in doubles
or longs where a bound says that these hold them, else in whole numbers of any size. A score that fits no long is
returned as the nearest long, and ranks by its own value. Vectors of another length than a query's
have no inner product with it and are not its candidates; vectors of no components have score 0 with each other.
Rows with a null vec_id take no part. Rows that repeat a vec_id are candidates and queries each; rows of the
query's own vec_id are not its candidates. Ties go to the smaller vec_id. Other columns are not read. No vectors
or no queries: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import partitions, prepare, record

SCALE, K, EVERY = 1024, 10, 100
#: Width of a quantised impact at least, quantised impacts of an index at most, components of a broadcast block,
#: candidates of one shard.
STEP, STEPS, BLOCK, SHARD = 8, 4096, 8 << 20, 65_536
#: A level reads segments of contributions down to this share of the largest; 0 reads all.
LEVELS = (0.5, 0.3, 0.18, 0.1, 0.05, 0.0)
#: Possible members that are scored exactly rather than read on, as a share of the shard.
FEW = 1 / 64
#: Components beyond which products may not be doubles; what whole numbers doubles and longs hold for sure.
FAR, DOUBLES, LONGS = 2.0**400, 2.0**52, 2.0**62


def whole(x: np.ndarray) -> list[int]:
    """floor(1024 x), whatever its size."""
    return [math.floor(c * SCALE) if abs(c) < FAR else int(c) * SCALE for c in x.tolist()]


def magnitude(x: np.ndarray) -> np.ndarray:
    """A class for each vector, by its largest component: 0 up to 8, then one for each factor of 16."""
    most = np.abs(x).max(axis=1, initial=0.0)
    return np.where(most > FAR, 999, np.ceil(np.log2(np.maximum(most, 8.0) / 8) / 4)).astype(np.int64)


class Index:
    """Impact-ordered postings of a shard: by dimension, vectors in order of their quantised impact, and where
    each segment (the postings of one impact) begins."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray) -> None:
        self.ids, self.raw = ids, raw
        self.most = float(np.abs(raw).max(initial=0.0)) * SCALE
        self.far = self.most > FAR * SCALE or not raw.shape[1]
        if self.far:
            return
        x = self.x = np.floor(raw * SCALE)
        width = max(STEP, float(x.max() - x.min()) / STEPS, self.most / 2**20)
        self.step = step = 2.0 ** math.ceil(math.log2(width))
        level = np.floor(x / step).astype(np.int64)
        self.base = int(level.min())
        order = np.argsort(level, axis=0, kind="stable")
        self.order = np.ascontiguousarray(order.T.astype(np.int32))
        by = np.ascontiguousarray(np.take_along_axis(level, order, axis=0).T)
        self.impact = by * step + step / 2
        self.count = int(level.max()) - self.base + 1
        self.starts = np.array([np.searchsorted(row, np.arange(self.base, self.base + self.count + 1)) for row in by])

    def top(self, raw: np.ndarray, own: int, k: int, floor: int | None) -> list[tuple[int, int]]:
        """(-score, id) of the k best, ties to the smaller id; fewer if `floor`, a score that k others reach, rules
        them out."""
        if self.far or np.abs(raw).max(initial=0.0) > FAR:
            return self.exact(np.nonzero(self.ids != own)[0], raw, k)
        n, q = len(self.ids), np.floor(raw * SCALE)
        size, step = np.abs(q), self.step
        score = np.zeros(n)
        # |x - impact| is at most half a step; sums beyond 2**53 lose their last bits
        rounding = float(size.sum()) * step / 2
        dims = np.arange(len(q))
        most = size * np.maximum(np.abs(self.impact[:, 0]), np.abs(self.impact[:, -1]))
        rounding += float(most.sum()) * len(q) * 2.0**-50
        others = self.ids != own
        rivals = int(others.sum())
        lo, hi = np.zeros(len(q), dtype=np.int64), np.full(len(q), n)  # unread: order[d, lo:hi]
        lo[q == 0] = n
        for part in LEVELS:
            # segments whose contribution is at least this much: the largest impacts at either end
            limit = part * float(most.max()) / np.maximum(size, 1)
            # contributions of the dimension's own largest impact at the most
            limit = np.minimum(limit, 2 * self.most + 4 * step)
            below = np.floor((-limit - step / 2) / step).astype(np.int64) - self.base + 1
            above = np.ceil((limit - step / 2) / step).astype(np.int64) - self.base
            a = self.starts[dims, np.clip(below, 0, self.count)] if part else hi
            b = self.starts[dims, np.clip(above, 0, self.count)] if part else hi
            a = np.clip(a, lo, hi)
            b = np.clip(b, a, hi)
            reads = [(d, s, e) for d in np.nonzero((a > lo) | (hi > b))[0] for s, e in ((lo[d], a[d]), (b[d], hi[d])) if e > s]
            if reads:
                at = np.concatenate([self.order[d, s:e] for d, s, e in reads])
                score += np.bincount(at, np.concatenate([q[d] * self.impact[d, s:e] for d, s, e in reads]), n)
            lo, hi = a, b
            # unread segments of a dimension lie between its impacts at lo and hi - 1
            some = np.nonzero(hi > lo)[0]
            ends = np.stack([q[some] * self.impact[some, lo[some]], q[some] * self.impact[some, hi[some] - 1]])
            up = float(np.maximum(ends.max(axis=0), 0).sum()) + rounding
            down = float(np.minimum(ends.min(axis=0), 0).sum()) - rounding
            bound = -np.inf if floor is None else as_double(floor) - abs(as_double(floor)) * 2.0**-50
            if rivals > k:
                bound = max(bound, np.partition(score[others], -k)[-k] + down)
            possible = np.nonzero(others & (score + up >= bound))[0]
            if not len(some) or len(possible) <= max(4 * k, n * FEW):
                break
        return self.exact(possible, raw, k)

    def exact(self, at: np.ndarray, raw: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(-score, id) of the k best of some rows."""
        far = self.far or np.abs(raw).max(initial=0.0) > FAR
        if not far:
            q = np.floor(raw * SCALE)
            bound = self.most * float(np.abs(q).max()) * len(q)
            if bound < LONGS:
                x = self.x[at]
                score = (x @ q).astype(np.int64) if bound < DOUBLES else x.astype(np.int64) @ q.astype(np.int64)
                best = np.lexsort((self.ids[at], -score))[:k]
                return list(zip((-score[best]).tolist(), self.ids[at[best]].tolist()))
            if len(at) > k:  # those that rounding may not rule out
                near = self.x[at] @ q
                off = (np.abs(self.x[at]) @ np.abs(q)) * len(q) * 2.0**-50
                at = at[near + off >= np.partition(near - off, -k)[-k]]
        ints = whole(raw)
        return sorted((-sum(a * b for a, b in zip(ints, whole(self.raw[i]))), int(self.ids[i])) for i in at)[:k]


def sortable(score: int) -> str:
    """A string for a score that fits no long, in the order of such scores; those that fit are between."""
    digits = str(abs(score))
    up = f"{len(digits):06d}{digits}"
    return f"2{up}" if score > 0 else "0" + up.translate(str.maketrans("0123456789", "9876543210"))


def as_double(score: int) -> float:
    try:
        return float(score)
    except OverflowError:
        return math.inf if score > 0 else -math.inf


def doubles(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array of doubles): vectors that take part."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: c.cast("double")).alias("v"))


def search(candidates: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score; both frames as doubles() gives them."""
    prepare(candidates.sparkSession)
    # each row is a query, under a number of its own
    asked = queries.select("vec_id", "v").withColumn("q", F.monotonically_increasing_id()).checkpoint()
    values = asked.agg(F.sum(F.size("v") + 2)).first()[0] or 0
    blocks = max(1, -(-values // BLOCK))
    dealt = candidates.repartition(partitions(candidates))
    if blocks > 1:
        dealt = dealt.checkpoint()
    found = None
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block) if blocks > 1 else asked
        shared = candidates.sparkSession.sparkContext.broadcast(by_length(mine.toArrow()))
        part = _search(dealt, shared, k)
        if blocks > 1:
            part = part.checkpoint()
            shared.unpersist()
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def rows_of(v: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of an array of vectors: by length, which they are and their components."""
    starts = v.offsets.to_numpy()
    flat, sizes = v.values.to_numpy(zero_copy_only=False), np.diff(starts)
    for n in np.unique(sizes).tolist():
        rows = np.nonzero(sizes == n)[0]
        yield n, rows, flat[starts[rows][:, None] + np.arange(n)]


def by_length(queries: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers, ids and components of queries, by the number of components."""
    held: dict[int, list[tuple[np.ndarray, ...]]] = {}
    for batch in queries.to_batches():
        q, ids = batch.column("q").to_numpy(), batch.column("vec_id").to_numpy()
        for n, rows, x in rows_of(batch.column("v")):
            held.setdefault(n, []).append((q[rows], ids[rows], x))
    return {n: tuple(map(np.concatenate, zip(*parts))) for n, parts in held.items()}


def _search(dealt: DataFrame, shared, k: int) -> DataFrame:
    schema = pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.string())])
    least, most = -(1 << 63), (1 << 63) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[int, list[tuple[int, int]]]] = {}

        def shard(ids: np.ndarray, x: np.ndarray) -> None:
            index = Index(ids, x)
            for number, query, v in zip(*shared.value[x.shape[1]]):
                had = best[number][1] if number in best else []
                new = index.top(v, query, k, -had[-1][0] if len(had) == k else None)
                best[number] = query, sorted(had + new)[:k] if had else new

        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            for n, rows, x in rows_of(batch.column("v")):
                if n not in shared.value:
                    continue
                kind = magnitude(x)
                for c in np.unique(kind).tolist():
                    held.setdefault((n, c), []).append((ids[rows[kind == c]], x[kind == c]))
                    if sum(len(i) for i, _ in held[n, c]) >= SHARD:
                        shard(*map(np.concatenate, zip(*held.pop((n, c)))))
        for parts in held.values():
            shard(*map(np.concatenate, zip(*parts)))
        for number, (query, found) in best.items():
            if found:
                score = [-s for s, _ in found]
                fits = [min(max(s, least), most) for s in score]
                beyond = ["1" if s == f else sortable(s) for s, f in zip(score, fits)]
                yield record(schema, [number] * len(found), [query] * len(found), [i for _, i in found], fits, beyond)

    return dealt.mapInArrow(run, "q long, query_id long, vec_id long, score long, beyond string")


def report(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: queries are the rows whose vec_id is divisible by `every`, candidates all."""
    rows = doubles(vectors)
    return search(rows, rows.where(F.col("vec_id") % every == 0), k)
