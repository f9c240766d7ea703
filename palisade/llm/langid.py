"""Language identification in two steps: the family first, then one-versus-one linear support vector
machines between the languages of that family.

A text becomes counts of byte n-grams (1 to 3) of its lower-cased letters, hashed to SIZE places, under a
square root and scaled to length one. Languages are grouped into families by average-link clustering of
their mean vectors, down to about the square root of their number. A linear machine for each family (against
the others) picks the family; within it each pair of languages has a machine and the most votes win, ties
to the larger sum of margins. Machines are fitted in numpy on at most TRAIN_ROWS documents, chosen by hash of
doc_id, an equal share of each language: all of those that have fewer, and what they leave goes to the others.

A null text, or one without a letter, is `und` with score 0. Rows with a null lang teach nothing; of rows that
repeat a doc_id and a lang one teaches (the smallest hash of its text), and they count as one for the bound. Repeated rows
are judged each on its own, texts of any length whole, n-grams across the parts in which they are counted included.
Equal votes and margins go to the language whose name comes first. doc_id is a number; columns other than it, text
and (for fit) lang are not read, whatever their names. With no language to learn, all is `und`; with one, all that
has letters is that one with score 1. No documents: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import crc_mod, prepare, record, slices

SIZE, TRAIN_ROWS, UNKNOWN = 2048, 4000, "und"
LETTER = regex.compile(r"\p{L}")
_TABLE = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))
_MULTIPLIER = np.uint32(2654435761)


def vector(text: str) -> np.ndarray:
    raw = b" " + b" ".join(text.lower().encode().translate(_TABLE).split()) + b" "
    counts = np.zeros(SIZE)
    for at in range(0, len(raw), 1 << 20):  # n-grams at cuts are counted with the part before
        b = np.frombuffer(raw[at : at + (1 << 20) + 2], np.uint8).astype(np.uint32)
        n = min(len(b), 1 << 20)
        code = b.copy()
        for size in (1, 2, 3):
            place = (code[:n] + np.uint32(size << 24)) * _MULTIPLIER >> np.uint32(21)
            counts += np.bincount(place, minlength=SIZE)
            if len(b) <= size:
                break
            code = (code[:-1] << np.uint32(8)) | b[size:]
    out = np.sqrt(counts)
    return (out / np.linalg.norm(out)).astype(np.float32)


def machine(x: np.ndarray, y: np.ndarray, c: float = 4.0, rounds: int = 80) -> np.ndarray:
    """Weights and offset of a linear support vector machine (squared hinge), y of -1 and 1, by accelerated
    gradient steps; classes weigh the same."""
    z = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * c * 10
    weight = weight.astype(np.float32)
    y = y.astype(np.float32)
    w = v = np.zeros(z.shape[1], np.float32)
    step = np.float32(1 / (1 + 4 * weight.sum()))
    for k in range(rounds):
        margin = 1 - y * (z @ v)
        new = v - step * (v - 2 * (weight * y * np.maximum(margin, 0)) @ z)
        v = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w


def families(means: np.ndarray) -> list[list[int]]:
    groups = [[k] for k in range(len(means))]
    likeness = means @ means.T
    while len(groups) > max(1, round(len(means) ** 0.5)):
        pairs = [(float(np.mean(likeness[np.ix_(a, b)])), -i, -j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        _, i, j = max(pairs)
        groups[-i] += groups.pop(-j)
    return [sorted(g) for g in groups]


class Model:
    def __init__(self, x: np.ndarray, langs: list[str]) -> None:
        self.names = sorted(set(langs))
        y = np.array([self.names.index(v) for v in langs], dtype=np.int64)
        if len(self.names) < 2:
            return
        means = np.array([x[y == k].mean(axis=0) for k in range(len(self.names))])
        self.families = families(means / np.linalg.norm(means, axis=1, keepdims=True))
        of = np.zeros(len(self.names), dtype=np.int64)
        for f, members in enumerate(self.families):
            of[members] = f
        self.family = np.array([machine(x, np.where(of[y] == f, 1, -1)) for f in range(len(self.families))])
        self.pairs = [(a, b) for members in self.families for i, a in enumerate(members) for b in members[i + 1 :]]
        self.pair = np.array([machine(x[(y == a) | (y == b)], np.where(y[(y == a) | (y == b)] == a, 1, -1)) for a, b in self.pairs]).reshape(len(self.pairs), SIZE + 1)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of names, and scores."""
        z = np.hstack([x, np.ones((len(x), 1), np.float32)])
        near = lambda m: 1 / (1 + np.exp(-3 * m))
        outer, inner = z @ self.family.T, z @ self.pair.T
        family = outer.argmax(axis=1) if len(self.families) > 1 else np.zeros(len(x), dtype=np.int64)
        sure = near(outer.max(axis=1)) if len(self.families) > 1 else np.ones(len(x))
        votes = np.zeros((len(x), len(self.names)))
        margin = np.zeros((len(x), len(self.names)))
        for k, (a, b) in enumerate(self.pairs):
            won = inner[:, k] > 0
            votes[won, a] += 1
            votes[~won, b] += 1
            margin[:, a] += inner[:, k]
            margin[:, b] -= inner[:, k]
        rank = votes + 0.5 + np.tanh(margin / 100) * 0.4
        for f, members in enumerate(self.families):
            rank[np.ix_(family != f, members)] = -1
        best = rank.argmax(axis=1)
        own = np.array([max(len(self.families[f]) - 1, 0) for f in family])
        inside = np.where(own > 0, near(margin[np.arange(len(x)), best] / np.maximum(own, 1)), 1.0)
        return best, np.clip(sure * inside, 0.0, 1.0)

    def score(self, raw: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(raw), [0.0] * len(raw)
        if not self.names:
            return langs, scores
        some = [k for k, t in enumerate(raw) if t and LETTER.search(t)]
        if len(self.names) == 1:
            for k in some:
                langs[k], scores[k] = self.names[0], 1.0
        elif some:
            best, sure = self.predict(np.array([vector(raw[k]) for k in some]))
            for k, b, s in zip(some, best, sure.tolist()):
                langs[k], scores[k] = self.names[b], s
        return langs, scores


def fit(docs: DataFrame, learn=None, most: int = TRAIN_ROWS) -> Model:
    """`learn` is a condition on doc_id (by default that of the held-out fold)."""
    prepare(docs.sparkSession)
    learn = crc_mod(3) != 1 if learn is None else learn
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learn)
    # ids are chosen without their texts: each language in 64 parts by hash, of each of which Spark keeps the first
    # ranks before it shuffles; then places in the language, by k and by hash among the (at most 64) rows of a k
    by_part = Window.partitionBy("lang", "part").orderBy("h", "doc_id")
    # a row for each id and language first, as the bound is one of ids: repeats use none of it up
    ids = rows.select("doc_id", "lang").distinct().withColumn("h", F.xxhash64("doc_id")).withColumn("part", F.pmod("h", F.lit(64)))
    some = ids.withColumn("k", F.row_number().over(by_part)).where(F.col("k") <= most // 16)
    earlier = Window.partitionBy("lang").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    before = some.groupBy("lang", "k").count().select("lang", "k", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    by_k = Window.partitionBy("lang", "k").orderBy("h", "doc_id", "part")
    placed = some.withColumn("r", F.row_number().over(by_k)).join(before, ["lang", "k"]).withColumn("place", F.col("before") + F.col("r"))
    chosen = placed.orderBy("place", "h", "doc_id", "lang").limit(most).select("doc_id", "lang")
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            some = [(i, v, t) for i, v, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "text"))) if LETTER.search(t)]
            yield record(schema, [s[0] for s in some], [s[1] for s in some], [vector(s[2]).astype(np.float16).tobytes() for s in some])

    texts = rows.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])
    # a doc_id of very many rows comes down to one a language in the tasks
    texts = texts.groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = sorted(texts.mapInArrow(run, "doc_id long, lang string, x binary").collect(), key=lambda r: (r.doc_id, r.lang, bytes(r.x)))
    x = np.array([np.frombuffer(r.x, np.float16) for r in got], dtype=np.float32).reshape(len(got), SIZE)
    return Model(x, [r.lang for r in got])


def report(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, one row per row of docs."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield record(schema, batch.column("doc_id").cast(pa.int64()), *shared.value.score(batch.column("text").to_pylist()))

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (crc_mod(3) == 1).alias("held_out"), "lang_pred", "score")
