"""Exact substring dedup: every byte of a LENGTH-byte string that also starts earlier is removed.

Where candidates come from. A LENGTH-byte window is assigned to one anchor: the GRAM-byte gram in it with the
smallest hash (leftmost of equal ones). Equal windows have equal anchors, so only windows under one anchor hash
can be equal. Consecutive windows of one document with the same anchor occurrence form a run, about one for
every 39 bytes of text, and every window lies in exactly one run; nothing is left out. A run is shuffled as
two 64-bit hashes (its anchor's, h, and g of the run's own bytes, length and anchor place) with its place.

1. Runs with equal (h, g) are the same bytes: all but the first are repeats whole. Tasks collapse these
   before the shuffle, so a copy that comes thousands of times is a few rows. A run whose h comes once has no
   equal windows anywhere and is dropped.
2. What is left are different runs under one h. One representative of each is cut out of its text and goes,
   by h, to shards of at most SHARD bytes. A shard gets a suffix array by Larsson-Sadakane refinement (only
   groups not yet sorted, prefix length doubling from 7) and common prefixes by Kasai's rule, run in
   lanes over the text. Suffixes in a row with LENGTH common bytes are equal windows; all but the earliest are
   repeats.
3. A group under one h that a shard's end cuts is merged across shards: the windows of the later shard are
   looked up by binary search in the sorted windows of the shards before.

An anchor inside a very common passage may have so many different surroundings that one task should not hold
them. Such anchors (over HOT different runs, or more where there are so many runs that this would be over ANCHORS
anchors) are split: each of their windows becomes a run of its own under its own hash. Different runs are counted on
the 16th of them whose hash g says so, wherever they lie, so an anchor can't hide in a few documents; and the count
decides only where work is done. What is broadcast is ANCHORS numbers at the most.

Documents go by doc_id (see common.numbered for nulls and repeats); null texts are empty and keep the hash of
nothing. Texts are bytes of any length; spans may begin within a character. Of equal strings the first stays, so
there are no ties. Extra columns, whatever their names, are left alone. No documents: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import named, numbered, partitions, prepare, record, renamed, slices, texts, trimmed
from palisade.llm.decontaminate import powers

LENGTH, GRAM = 100, 24
#: Bytes of a shard's text; bytes of text hashed at once; runs that a task holds before it collapses them.
SHARD, PIECE, HELD = 1 << 19, 1 << 19, 400_000
#: Different runs under one anchor beyond which its windows are dealt out singly; one run in so many is looked at
#: for that; anchors that may be found so at most (a run is under one anchor).
HOT, SAMPLE, ANCHORS = 1000, 16, 4_000_000
_U = np.uint64
_BYTES = np.random.default_rng(100).integers(0, 1 << 63, (2, 256), dtype=np.uint64) * _U(2) + _U(1)
_PLACE = (1 << 22) - 1


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` values in a row."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(x)] = x
    block = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(text: bytes, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM, hot: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Runs of text's windows, which don't cross the pieces that end at `ends`: h, g, start, windows."""
    raw = np.frombuffer(text, np.uint8)
    n = len(raw) - length + 1
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n <= 0:
        return none
    up, down = powers(len(raw))
    sums = []
    for values in _BYTES:
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(values[raw] * up, out=total[1:])
        sums.append(total)
    h = mix((sums[0][gram:] - sums[0][:-gram]) * down[: len(raw) - gram + 1])
    packed = (h & ~_U(_PLACE)) | np.arange(len(h), dtype=np.uint64)
    place = (sliding_min(packed, length - gram + 1) & _U(_PLACE)).astype(np.int64)
    # the end of the piece that each position is in
    sizes = np.diff(np.concatenate([[0], ends]))
    start = np.nonzero(np.arange(n) + length <= np.repeat(ends, sizes)[:n])[0]
    if not len(start):
        return none
    first = np.ones(len(start), dtype=bool)
    first[1:] = (place[start[1:]] != place[start[:-1]]) | (start[1:] != start[:-1] + 1)
    a = start[first]
    count = np.diff(np.concatenate([np.nonzero(first)[0], [len(start)]]))
    at = place[a]
    own = h[at]
    if hot is not None and len(hot):
        common = np.isin(own, hot)
        if common.any():
            single = np.concatenate([np.arange(s, s + c) for s, c in zip(a[common], count[common])])
            other = mix((sums[0][single + length] - sums[0][single]) * down[single] + _U(7))
            a = np.concatenate([a[~common], single])
            at = np.concatenate([at[~common], single])
            own = np.concatenate([own[~common], other])
            count = np.concatenate([count[~common], np.ones(len(single), dtype=count.dtype)])
    bulk = (sums[1][a + count + length - 1] - sums[1][a]) * down[a]
    g = mix(bulk + (count * 4096 + (at - a)).astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    return own, g, a, count


def pieces(batch: pa.RecordBatch, length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of a batch, joined up to PIECE bytes: bytes, ends of pieces, rid and offset of each piece. Longer
    texts are cut, with length - 1 bytes in common, so that each window is in one piece."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def joined() -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        out = b"".join(x[2] for x in held), np.cumsum([len(x[2]) for x in held]), np.array([x[0] for x in held]), np.array([x[1] for x in held])
        held.clear()
        return out

    for rid, text in zip(batch.column("rid").to_pylist(), texts(batch)):
        for at in range(0, max(len(text) - length + 1, 0), PIECE):
            part = text[at : at + PIECE + length - 1]
            if size + len(part) > 2 * PIECE and held:
                yield joined()
                size = 0
            held.append((rid, at, part))
            size += len(part)
    if held:
        yield joined()


_RUNS = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("rid", pa.int64()), ("a", pa.int32()), ("n", pa.int32()), ("whole", pa.bool_())])
_RUNS_SQL = "h long, g long, rid long, a int, n int, whole boolean"


def gathered(docs: DataFrame, length: int, hot=None) -> DataFrame:
    """Runs of all documents. whole: a stretch of n bytes from a that is known to be repeated, found by
    collapsing equal runs in the task; else a run of n windows from a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            h, g, rid, a, n = map(np.concatenate, zip(*held))
            held.clear()
            order = np.lexsort((a, rid))
            order = order[np.argsort((h ^ mix(g))[order], kind="stable")]
            h, g, rid, a, n = (x[order] for x in (h, g, rid, a, n))
            again = np.zeros(len(h), dtype=bool)
            again[1:] = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
            new = ~again
            yield from out(h[new], g[new], rid[new], a[new], n[new], False)
            if again.any():
                r, b, e = merged(rid[again], a[again], a[again] + n[again] + length - 1)
                # whole stretches only pass through: any key will do
                yield from out(mix(b.astype(np.uint64) + r.astype(np.uint64)), np.zeros(len(r), np.uint64), r, b, e - b, True)

        def out(h, g, rid, a, n, whole) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(h), 50_000):
                s = slice(at, at + 50_000)
                yield record(_RUNS, h[s].view(np.int64), g[s].view(np.int64), rid[s], a[s].astype(np.int32), n[s].astype(np.int32), np.full(len(h[s]), whole))

        size = 0
        for batch in slices(batches, PIECE):
            for text, ends, rids, offsets in pieces(batch, length):
                h, g, a, n = runs(text, ends, length, hot=hot.value if hot is not None else None)
                k = np.searchsorted(ends, a, side="right")
                held.append((h, g, rids[k], a - np.concatenate([[0], ends[:-1]])[k] + offsets[k], n))
                size += len(h)
            if size > HELD:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    return docs.select("rid", "text").mapInArrow(trimmed(run), _RUNS_SQL)


def merged(rid: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches, joined where they touch or overlap; in a document, ends ascend with begins."""
    order = np.lexsort((begin, rid))
    rid, begin, end = rid[order], begin[order], end[order]
    first = np.ones(len(rid), dtype=bool)
    first[1:] = (rid[1:] != rid[:-1]) | (begin[1:] > end[:-1])
    at = np.nonzero(first)[0]
    return rid[at], begin[at], np.maximum.reduceat(end, at)


_PARTS = pa.schema([("rid", pa.int64()), ("a", pa.int32()), ("n", pa.int32()), ("h", pa.int64()), ("check", pa.bool_())])


def resolved(found: DataFrame, length: int) -> DataFrame:
    """Of runs under one h: repeats whole (n bytes from a) and representatives to check (n windows from a)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("h", "g", "rid", "a", "n", "whole")) for b in batches]
        if not held:
            return
        h, g, rid, a, n, whole = map(np.concatenate, zip(*held))
        del held

        def out(rid, a, n, h, check) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(rid), 50_000):
                s = slice(at, at + 50_000)
                yield record(_PARTS, rid[s], a[s], n[s], h[s], np.full(len(rid[s]), check))

        yield from out(rid[whole], a[whole], n[whole], np.zeros(int(whole.sum()), np.int64), False)
        h, g, rid, a, n = (x[~whole] for x in (h, g, rid, a, n))
        order = np.argsort(h)
        s = h[order]
        same = np.zeros(len(s), dtype=bool)
        same[1:] = s[1:] == s[:-1]
        same[:-1] |= same[1:]
        order = order[same]  # an h that comes once has no equals
        h, g, rid, a, n = (x[order] for x in (h, g, rid, a, n))
        order = np.lexsort((a, rid, g, h))
        h, g, rid, a, n = (x[order] for x in (h, g, rid, a, n))
        if not len(h):
            return
        new_h = np.concatenate([[True], h[1:] != h[:-1]])
        new_g = new_h | np.concatenate([[True], g[1:] != g[:-1]])
        again = ~new_g
        yield from out(rid[again], a[again], n[again] + np.int32(length - 1), np.zeros(int(again.sum()), np.int64), False)
        group = np.cumsum(new_h) - 1
        several = new_g & (np.bincount(group, new_g)[group] > 1)
        yield from out(rid[several], a[several], n[several], h[several], True)

    return found.mapInArrow(trimmed(run), "rid long, a int, n int, h long, check boolean")


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by Larsson-Sadakane refinement: each round sorts only the groups whose members still
    agree, by the rank of what follows. To the end, as Kasai's rule needs the true order."""
    n = len(text)
    # seven bytes to a key, nine bits each, so that the end of the text is less than any byte
    padded = np.concatenate([text.astype(np.uint64) + _U(1), np.zeros(7, np.uint64)])
    key = np.zeros(n, dtype=np.uint64)
    for k in range(7):
        key = key << _U(9) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    s = key[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    rank = np.empty(n, dtype=np.int64)
    at = np.arange(n)
    rank[order] = np.maximum.accumulate(np.where(first, at, 0))  # a group's number is where it begins
    h = 7
    while h < n:
        # places of groups of more than one
        last = np.concatenate([first[1:], [True]])
        open_ = np.nonzero(~(first & last))[0]
        if not len(open_):
            break
        own = order[open_]
        follow = np.where(own + h < n, rank[np.minimum(own + h, n - 1)] + 1, 0)
        key = rank[own] << 32 | follow
        inner = np.argsort(key, kind="stable")
        order[open_] = own[inner]
        s = key[inner]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        first[open_] = new
        rank[own[inner]] = np.maximum.accumulate(np.where(new, open_, 0))
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, cap: int = LENGTH, lane: int = 256) -> np.ndarray:
    """Bytes, `cap` at the most, that each suffix shares with the one before it in order. Kasai's rule (at the
    next place of the text the length falls by one at most) in lanes: stretches of text that go on together."""
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([text.astype(np.int16), np.full(cap + 1, -1, np.int16)])
    out = np.zeros(n, dtype=np.int64)
    i = np.arange(0, n, lane)
    stop = np.minimum(i + lane, n)
    length = np.zeros(len(i), dtype=np.int64)
    while len(i):
        j = before[i]
        ok = j >= 0
        # ends of the text differ from all: -1 against -1 can't be, as the two places differ
        grow = ok & (length < cap)
        p, q = np.minimum(i + length, n + cap), np.minimum(j + length, n + cap)
        grow &= (padded[p] == padded[q]) & (padded[p] >= 0)
        length[grow] += 1
        done = ~grow
        out[i[done]] = np.where(ok[done], length[done], 0)
        length[done] = np.maximum(length[done] - 1, 0)
        i[done] += 1
        left = i < stop
        if not left.all():
            i, stop, length = i[left], stop[left], length[left]
    return out[order]


class Shards:
    """Windows of runs, shard by shard; remembers the windows of the last h in case the next shard goes on with it."""

    def __init__(self, length: int) -> None:
        self.length, self.h = length, None
        self.before: list[list[np.ndarray]] = []  # sorted windows, rids, places

    def repeats(self, h: np.ndarray, rid: np.ndarray, a: np.ndarray, n: np.ndarray, text: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """rid and start of windows that are not the first of their kind; rows come sorted by h."""
        length = self.length
        raw = np.frombuffer(b"".join(text), np.uint8)
        sizes = np.array([len(t) for t in text])
        base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        order = suffix_array(raw)
        same = common_prefixes(raw, order, length) >= length
        group = np.cumsum(~same) - 1
        row = np.searchsorted(base, order, side="right") - 1
        inside = order - base[row]
        real = inside < n[row]  # windows, not what begins at the end of one run and goes on in the next
        group, row, inside, order = group[real], row[real], inside[real], order[real]
        w_rid, w_at = rid[row], a[row].astype(np.int64) + inside
        by = np.lexsort((w_at, w_rid, group))
        first = np.concatenate([[True], group[by][1:] != group[by][:-1]])
        out_rid, out_at = [w_rid[by][~first]], [w_at[by][~first]]
        kept = by[first]  # in order of their windows
        if self.h is not None and h[0] == self.h:
            mine = kept[h[row[kept]] == self.h]
            view = np.lib.stride_tricks.sliding_window_view(raw, length)
            windows = np.ascontiguousarray(view[order[mine]]).view(f"S{length}").ravel()
            m_rid, m_at = w_rid[mine], w_at[mine]
            alive = np.ones(len(mine), dtype=bool)
            for part in self.before:
                at = np.searchsorted(part[0], windows)
                hit = at < len(part[0])
                hit[hit] = part[0][at[hit]] == windows[hit]
                hit &= alive
                k = at[hit]
                later = (m_rid[hit] > part[1][k]) | ((m_rid[hit] == part[1][k]) & (m_at[hit] > part[2][k]))
                who = np.nonzero(hit)[0]
                out_rid += [m_rid[who[later]], part[1][k[~later]]]
                out_at += [m_at[who[later]], part[2][k[~later]]]
                # the earlier of two stays the one that others are compared with
                part[1][k[~later]], part[2][k[~later]] = m_rid[who[~later]], m_at[who[~later]]
                alive[who] = False
        else:
            self.before = []
        if self.h != h[-1]:
            self.before = []
        self.h = h[-1]
        mine = kept[h[row[kept]] == self.h]
        if len(mine):
            view = np.lib.stride_tricks.sliding_window_view(raw, length)
            windows = np.ascontiguousarray(view[order[mine]]).view(f"S{length}").ravel()
            m_rid, m_at = w_rid[mine].copy(), w_at[mine].copy()
            if self.before:
                known = np.zeros(len(mine), dtype=bool)
                for part in self.before:
                    at = np.minimum(np.searchsorted(part[0], windows), len(part[0]) - 1)
                    known |= part[0][at] == windows
                windows, m_rid, m_at = windows[~known], m_rid[~known], m_at[~known]
            if len(windows):
                self.before.append([windows, m_rid, m_at])
        return np.concatenate(out_rid), np.concatenate(out_at)


_SPANS = pa.schema([("rid", pa.int64()), ("a", pa.int32()), ("n", pa.int32())])


def compared(joined: DataFrame, length: int, n: int) -> DataFrame:
    """Repeated stretches (rid, n bytes from a) among the representatives that documents (rid, text, parts) carry,
    in n partitions."""
    cut = pa.schema([("h", pa.int64()), ("rid", pa.int64()), ("a", pa.int32()), ("n", pa.int32()), ("part", pa.binary())])

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts = batch.column("parts")
            offsets, flat = parts.offsets.to_numpy(), parts.values
            check, a, n, h = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("check", "a", "n", "h"))
            raw, rids = texts(batch), batch.column("rid").to_numpy()
            valid = parts.is_valid().to_numpy(zero_copy_only=False)
            rows = []
            for k in np.nonzero(valid)[0]:
                for i in range(offsets[k], offsets[k + 1]):
                    if check[i]:
                        rows.append((h[i], rids[k], a[i], n[i], raw[k][a[i] : a[i] + n[i] + length - 1]))
            if rows:
                yield record(cut, *map(list, zip(*rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(length)
        held: list[tuple[np.ndarray, ...]] = []
        text: list[bytes] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rid, at = shards.repeats(*map(np.concatenate, zip(*held)), text)
            held.clear()
            text.clear()
            if len(rid):
                r, b, e = merged(rid, at, at + length)
                yield record(_SPANS, r, b.astype(np.int32), (e - b).astype(np.int32))

        for batch in batches:
            for part in slices([batch], SHARD // 2):
                held.append(tuple(part.column(c).to_numpy() for c in ("h", "rid", "a", "n")))
                text += part.column("part").to_pylist()
                size += part.nbytes
                if size > SHARD:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    cut_out = joined.mapInArrow(cuts, "h long, rid long, a int, n int, part binary")
    return cut_out.repartition(n, "h").sortWithinPartitions("h").mapInArrow(trimmed(run), "rid long, a int, n int")


def hot_anchors(docs: DataFrame, length: int) -> np.ndarray:
    """Anchors with too many different runs for one task, ANCHORS at the most."""
    seen = pa.schema([("h", pa.int64()), ("g", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, PIECE):
            for text, ends, _, _ in pieces(batch, length):
                h, g, _, _ = runs(text, ends, length)
                some = g % _U(SAMPLE) == 0
                found = np.unique(np.stack([h[some], g[some]]), axis=1).view(np.int64)
                yield record(seen, found[0], found[1])

    # equal runs are equal pairs, which tasks put together before the shuffle
    counts = docs.select("rid", "text").mapInArrow(trimmed(run), "h long, g long").distinct().groupBy("h").count().checkpoint()
    every = counts.agg(F.sum("count")).first()[0] or 0
    least = max(HOT, every * SAMPLE // ANCHORS)
    found = counts.where(F.col("count") * SAMPLE > least).select("h").toArrow().column("h").to_numpy()
    return np.sort(found).view(np.uint64)


def listed(parts: DataFrame, n: int, checks: bool) -> DataFrame:
    """rid and its stretches as one array (structs a, n; with `checks` h and check too), in n partitions. Stretches
    that touch become one on the way, but for those that are still to check."""
    names = ("a", "n", "h", "check") if checks else ("a", "n")
    kind = pa.struct([(c, _PARTS.field(c).type) for c in names])
    schema = pa.schema([("rid", pa.int64()), ("parts", pa.list_(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def joined() -> tuple[np.ndarray, ...]:
            rid, a, n_, h, check = map(np.concatenate, zip(*held))
            r, begin, end = merged(rid[~check], a[~check], (a + n_)[~check])
            new = r, begin, end - begin, np.zeros(len(r), np.int64), np.zeros(len(r), bool)
            out = [np.concatenate([x, y[check]]) for x, y in zip(new, (rid, a, n_, h, check))]
            order = np.lexsort((out[1], out[0]))
            return tuple(x[order] for x in out)

        def put(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            rid = rows[0]
            first = np.nonzero(np.concatenate([[True], rid[1:] != rid[:-1]]))[0]
            ends = np.concatenate([first, [len(rid)]])
            for at in range(0, len(first), 2000):
                lo, hi = ends[at], ends[min(at + 2000, len(first))]
                values = [pa.array(x[lo:hi], kind.field(c).type) for c, x in zip(names, rows[1:])]
                lists = pa.ListArray.from_arrays((ends[at : at + 2001] - lo).astype(np.int32), pa.StructArray.from_arrays(values, names=list(names)))
                yield record(schema, rid[first[at : at + 2000]], lists)

        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names]
            if not checks:
                own += [np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)]
            held.append(tuple(own))
            size += batch.num_rows
            if size > HELD:
                rows = joined()
                held.clear()
                last = int(np.searchsorted(rows[0], rows[0][-1]))  # whose stretches may go on
                if last:
                    yield from put(tuple(x[:last] for x in rows))
                held.append(tuple(x[last:] for x in rows))
                size = 0
        if held:
            yield from put(joined())

    inner = "a: int, n: int, h: bigint, check: boolean" if checks else "a: int, n: int"
    dealt = parts.select("rid", *names).repartition(n, "rid").sortWithinPartitions("rid", "a")
    return dealt.mapInArrow(trimmed(run), f"rid long, parts array<struct<{inner}>>")


def marked(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, rid, text of documents with what of them is repeated: parts and more, arrays of structs a, n
    (n bytes from a; those of parts with `check` don't count)."""
    spark = docs.sparkSession
    prepare(spark)
    n = partitions(docs)
    hot = spark.sparkContext.broadcast(hot_anchors(docs, length))
    parts = resolved(gathered(docs, length, hot).repartition(n, "h"), length)
    by_row = listed(parts, n, True).checkpoint()
    # texts are shuffled once: both uses of this join have the same columns and filters, so that Spark reuses
    # the exchange
    with_parts = docs.repartition(n, "rid").join(by_row, "rid", "left")
    more = listed(compared(with_parts, length, n), n, False).withColumnRenamed("parts", "more")
    return with_parts.join(more, "rid", "left")


def cover(batch: pa.RecordBatch, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes of the joined texts are repeated; where texts begin."""
    begins = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    edge = np.zeros(begins[-1] + 1, dtype=np.int32)
    for name in ("parts", "more"):
        lists = batch.column(name)
        row = np.repeat(np.arange(len(raw)), np.diff(lists.offsets.to_numpy()))
        flat = lists.values[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
        a, n = flat.field("a").to_numpy(), flat.field("n").to_numpy()
        if name == "parts":
            use = ~flat.field("check").to_numpy(zero_copy_only=False)
            row, a, n = row[use], a[use], n[use]
        at = begins[row] + a
        np.add.at(edge, at, 1)
        np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0, begins


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = texts(batch)
            gone, begins = cover(batch, raw)
            rows = []
            for k, text in enumerate(raw):
                own = gone[begins[k] : begins[k + 1]]
                removed = int(own.sum())
                spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()) if removed else 0
                kept = np.frombuffer(text, np.uint8)[~own].tobytes() if removed else text
                rows.append((len(text), removed, spans, hashlib.sha256(kept).hexdigest()))
            yield record(schema, batch.column("doc_id").cast(pa.int64()), *map(list, zip(*rows)))

    return marked(numbered(docs, "text"), length).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs, all columns and rows, without repeated bytes; what is left of cut characters goes too. n_chars,
    where there is such a column, follows the text. A null text stays null."""
    held = numbered(renamed(docs), "text", *(f"_{k}" for k in range(len(docs.columns) - 2)))
    kind = held.drop("rid").schema
    names = kind.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = texts(batch)
            gone, begins = cover(batch, raw)
            out = []
            for k, (text, real) in enumerate(zip(raw, batch.column("text").is_valid().to_pylist())):
                own = gone[begins[k] : begins[k + 1]]
                kept = np.frombuffer(text, np.uint8)[~own].tobytes() if own.any() else text
                out.append(kept.decode("utf-8", "ignore") if real else None)
            columns = [pa.array(out, batch.schema.field("text").type) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = named(marked(held, length).mapInArrow(run, kind), docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out
