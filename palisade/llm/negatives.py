"""Hard-negative mining by distributed radix selection.

An anchor's positives are the rows of its label that score highest with it; each (anchor, positive) pair has a
window of scores, low to high per cent of the positive's score, in which the rows of other labels that score highest
are its hard negatives. Scores are integer inner products of floor(256 x) by component.

Which score is the k-th highest of a window is found by radix selection: each task counts the scores of its rows by
the window's leading digit, the counts are added up, and the digit that holds the k-th score becomes the window's
interval for the next digit, until the score is known. A task reports the digits from the top only until its own
rows make up what is sought, as the sought digit can't lie below that: no more than k counts a window and task,
whatever the data. Then the rows at or over the k-th score are gathered, and no other; of rows that tie at that
score a task gives the k of smallest vec_id, so that copies by the thousand don't meet anywhere. Nothing is
approximate, and no task holds more than a batch of rows and the counts of a block of anchors.

Anchors are met in blocks of ANCHORS (and of COMPONENTS components) at most; a block, its windows and the state of
their selection are on the driver and broadcast, and let go before the next. Anchors that grow with the rows make
the work grow with the square of the table, a stated query set against all rows.

Rows with a null vec_id, a null label, a null vector or any null or non-finite component take no part. Vectors of
another length than an anchor's have no score with it. Rows of the anchor's own vec_id are not its positives. Rows
that repeat a vec_id are anchors, positives and negatives each. Ties go to the smaller vec_id, rows that tie in that
too to any of them (they are alike in the result). Windows of a negative score are empty. A score that fits no long
counts as the nearest long. Other columns are not read. No rows or no anchors: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import prepare, record
from palisade.llm.topk import rows_of

SCALE, POSITIVES, NEGATIVES, LOW, HIGH, EVERY = 256, 5, 10, 30, 90, 100
#: Values of a digit; anchors and their components in a block; scores that a task holds at a time.
DIGIT, ANCHORS, COMPONENTS, SCORES = 256, 2048, 8 << 20, 1 << 18
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def whole(x: np.ndarray) -> list[int]:
    """floor(256 x), whatever its size."""
    return [math.floor(c * SCALE) if abs(c) < 2.0**900 else int(c) * SCALE for c in x.tolist()]


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of each row of x with each of q, as longs."""
    near = math.sqrt(2.0**52 / max(x.shape[1], 1)) / SCALE - 1  # up to this, doubles hold all sums
    xs, qs = np.abs(x).max(axis=1, initial=0.0) < near, np.abs(q).max(axis=1, initial=0.0) < near
    out = np.zeros((len(x), len(q)), dtype=np.int64)
    if xs.all() and qs.all():
        return (np.floor(x * SCALE) @ np.floor(q * SCALE).T).astype(np.int64)
    out[np.ix_(xs, qs)] = np.floor(x[xs] * SCALE) @ np.floor(q[qs] * SCALE).T
    far = {int(j): whole(q[j]) for j in range(len(q))}
    for i in range(len(x)):
        a = whole(x[i])
        for j in np.nonzero(~(qs & xs[i]))[0].tolist():
            out[i, j] = min(max(sum(u * v for u, v in zip(a, far[j])), LEAST), MOST)
    return out


def eligible(vectors: DataFrame, relabel=None) -> DataFrame:
    """vec_id, label and v (array of doubles) of the rows that take part; `relabel` is an expression for the label."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    label = F.col("label") if relabel is None else relabel
    v = F.transform("embedding", lambda c: c.cast("double"))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))


class Block:
    """Anchors of a block by their number of components: row numbers, ids, labels and vectors."""

    def __init__(self, anchors: pa.Table) -> None:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for batch in anchors.to_batches():
            a, ids, labels = (batch.column(c).to_numpy() for c in ("a", "vec_id", "label"))
            for n, rows, x in rows_of(batch.column("v")):
                held.setdefault(n, []).append((a[rows], ids[rows], labels[rows], x))
        self.anchors = {n: tuple(map(np.concatenate, zip(*parts))) for n, parts in held.items()}

    def scored(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray, np.ndarray]]:
        """Of rows, SCORES scores at a time: number of components, which anchors, ids, labels, scores (rows by
        anchors)."""
        for batch in batches:
            ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
            for n, rows, x in rows_of(batch.column("v")):
                if n not in self.anchors:
                    continue
                q = self.anchors[n][3]
                step = max(1, SCORES // len(rows))
                for at in range(0, len(q), step):
                    some = slice(at, at + step)
                    yield n, some, ids[rows], labels[rows], scores(x, q[some])


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(score) > 4 * k:
        some = np.nonzero(score >= np.partition(score, -k)[-k])[0]
        return some[np.lexsort((ids[some], -score[some]))[:k]]
    return np.lexsort((ids, -score))[:k]


class Best:
    """The k best (score, id) of each number, as they come."""

    def __init__(self, k: int) -> None:
        self.k, self.held = k, {}

    def add(self, number: int, score: np.ndarray, ids: np.ndarray) -> None:
        had = self.held.get(number)
        if had is not None:
            if len(had[0]) == self.k:
                some = score >= had[0][-1]
                if not some.any():
                    return
                score, ids = score[some], ids[some]
            score, ids = np.concatenate([had[0], score]), np.concatenate([had[1], ids])
        at = best(score, ids, self.k)
        self.held[number] = score[at], ids[at]

    def columns(self) -> list[np.ndarray]:
        """Numbers, scores and ids."""
        parts = [(np.full(len(s), w), s, i) for w, (s, i) in self.held.items() if len(s)]
        return list(map(np.concatenate, zip(*parts))) if parts else []


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, k: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the k best rows of other labels whose
    score is from low to high per cent of the positive's; both frames as eligible() gives them."""
    spark = rows.sparkSession
    prepare(spark)
    # each row is an anchor, under a number of its own
    asked = anchors.select("vec_id", "label", "v").withColumn("a", F.monotonically_increasing_id()).checkpoint()
    size = asked.agg(F.count("*"), F.sum(F.size("v") + 2)).first()
    blocks = max(1, -(-size[0] // ANCHORS), -(-(size[1] or 0) // COMPONENTS))
    rows = rows.select("vec_id", "label", "v")
    found = None
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("a"), F.lit(blocks)) == block) if blocks > 1 else asked
        part = _mine(rows, Block(own.toArrow()), positives, k, low, high)
        if blocks > 1:
            part = part.checkpoint()
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("a", "copy").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


class Windows:
    """The windows of a block: anchor (its place among those of its length), positive, bounds, and the state of the
    selection: `top` and `low`, the scores among which the k-th is, `need`, which of those it is, `step`, the width of
    the next digit, and `done`."""

    def __init__(self, block: Block, pairs: pa.Table, k: int, low: int, high: int) -> None:
        place = {int(a): (n, i) for n, (numbers, *_) in block.anchors.items() for i, a in enumerate(numbers)}
        held: dict[int, list[tuple[int, ...]]] = {}
        for a, copy, positive, score in zip(*(pairs.column(c).to_pylist() for c in ("a", "copy", "id", "score"))):
            least, most = -(-low * score // 100), high * score // 100
            if least <= most:
                n, i = place[a]
                held.setdefault(n, []).append((i, least, most, positive, score, copy, a, int(block.anchors[n][1][i])))
        self.k, self.of, at = k, {}, 0
        for n, some in held.items():
            some.sort()
            self.of[n] = at, at + len(some)
            at += len(some)
        columns = list(zip(*(w for some in held.values() for w in some))) or [()] * 8
        self.anchor, self.least, self.most, self.positive, self.score, self.copy, self.number, self.id = (np.array(c, dtype=np.int64) for c in columns)
        self.top, self.low = self.most.copy(), self.least.copy()
        self.need = np.full(at, k)
        # widths don't overflow, as bounds have one sign
        self.step = np.array([DIGIT ** max(0, -(-(int(a - b)).bit_length() // 8) - 1) for a, b in zip(self.top, self.low)], dtype=np.int64)
        self.done = self.top == self.low

    def within(self, n: int, some: slice, labels: np.ndarray, block: Block, score: np.ndarray, among: np.ndarray, top: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of the windows `among` whose anchors are those of `score`'s columns: their numbers, which rows (by windows)
        are of another label and have a score from `low` to `top`, and the scores."""
        first, last = self.of.get(n, (0, 0))
        a, b = first + np.searchsorted(self.anchor[first:last], (some.start, some.stop))
        w = among[np.searchsorted(among, a) : np.searchsorted(among, b)]
        for at in range(0, len(w), 1024):
            part = w[at : at + 1024]
            i = self.anchor[part]
            its, kind = score[:, i - some.start], block.anchors[n][2][i]
            yield part, (its >= self.low[part]) & (its <= top[part]) & (labels[:, None] != kind), its

    def settle(self, chosen: pa.Table) -> None:
        """Goes on with the digits that hold the sought scores: window, digit, above (scores over it), count. A window
        that isn't among them has fewer scores than are sought, and all of them qualify."""
        going = np.zeros(len(self.done), dtype=bool)
        w, digit, above, count = (chosen.column(c).to_numpy() for c in ("w", "digit", "above", "n"))
        going[w] = True
        self.done |= ~going
        self.top[w] -= digit * self.step[w]
        self.low[w] = np.maximum(self.low[w], self.top[w] - self.step[w] + 1)
        self.need[w] -= above
        self.done[w] |= (self.need[w] == count) | (self.top[w] == self.low[w])
        self.step[w] = np.maximum(self.step[w] // DIGIT, 1)


def _mine(rows: DataFrame, block: Block, positives: int, k: int, low: int, high: int) -> DataFrame:
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(block)
    windows = Windows(block, _positives(rows, shared, positives).toArrow(), k, low, high)
    order = Window.partitionBy("w").orderBy("digit")
    while not windows.done.all():
        state = context.broadcast(windows)
        counts = _counts(rows, shared, state).groupBy("w", "digit").agg(F.sum("n").alias("n"), F.max("need").alias("need"))
        above = counts.withColumn("above", F.sum("n").over(order) - F.col("n"))
        windows.settle(above.where((F.col("above") < F.col("need")) & (F.col("above") + F.col("n") >= F.col("need"))).toArrow())
        state.unpersist()
    return _gathered(rows, shared, context.broadcast(windows))


def _positives(rows: DataFrame, shared, k: int) -> DataFrame:
    """a, copy (rank), id, score of the k best rows of the anchor's label."""
    schema = pa.schema([("a", pa.int64()), ("score", pa.int64()), ("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Best(k)
        for n, some, ids, labels, score in shared.value.scored(batches):
            numbers, own, kind, _ = (c[some] for c in shared.value.anchors[n])
            mine = (labels[:, None] == kind) & (ids[:, None] != own)
            for j, a in enumerate(numbers.tolist()):
                at = np.nonzero(mine[:, j])[0]
                found.add(a, score[at, j], ids[at])
        if out := found.columns():
            yield record(schema, *out)

    order = Window.partitionBy("a").orderBy(F.desc("score"), "id")
    out = rows.mapInArrow(run, "a long, score long, id long").withColumn("copy", F.row_number().over(order))
    return out.where(F.col("copy") <= k)


def _counts(rows: DataFrame, shared, state) -> DataFrame:
    """w, digit, n, need: how many of a task's rows have a digit, from the highest scores down to what is sought."""
    schema = pa.schema([("w", pa.int64()), ("digit", pa.int64()), ("n", pa.int64()), ("need", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = state.value
        going = np.nonzero(~windows.done)[0]
        counts = np.zeros((len(going), DIGIT), dtype=np.int64)
        for n, some, _, labels, score in shared.value.scored(batches):
            for w, inside, its in windows.within(n, some, labels, shared.value, score, going, windows.top):
                r, c = np.nonzero(inside)
                digit = (windows.top[w][c] - its[r, c]) // windows.step[w][c]
                at = np.searchsorted(going, w)
                counts[at] += np.bincount(c * DIGIT + digit, minlength=len(w) * DIGIT).reshape(len(w), DIGIT)
        above = counts.cumsum(axis=1) - counts
        i, digit = np.nonzero((counts > 0) & (above < windows.need[going][:, None]))
        if len(i):
            yield record(schema, going[i], digit, counts[i, digit], windows.need[going[i]])

    return rows.mapInArrow(run, "w long, digit long, n long, need long")


def _gathered(rows: DataFrame, shared, state) -> DataFrame:
    """The rows that qualify for each window, of a task's rows that tie at the k-th score those of the smallest ids."""
    names = ("a", "copy", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
    schema = pa.schema([(c, pa.int64()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = state.value
        every, found = np.arange(len(windows.done)), Best(windows.k)
        for n, some, ids, labels, score in shared.value.scored(batches):
            for w, inside, its in windows.within(n, some, labels, shared.value, score, every, windows.most):
                for j in np.nonzero(inside.any(axis=0))[0].tolist():
                    at = np.nonzero(inside[:, j])[0]
                    found.add(int(w[j]), its[at, j], ids[at])
        if out := found.columns():
            w, score, ids = out
            yield record(schema, windows.number[w], windows.copy[w], windows.id[w], windows.positive[w], windows.score[w], ids, score)

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))


#: The contract's labels: those of rows whose vec_id is divisible by 7 go up by one, of ten.
def shifted():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def report(vectors: DataFrame, every: int = EVERY) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: anchors are the rows whose vec_id is
    divisible by `every`, all rows are candidates."""
    rows = eligible(vectors, shifted())
    return mine(rows, rows.where(F.col("vec_id") % every == 0))
