"""Quality classifier: random-indexing word vectors, pooled, under a two-layer network.

Tokens (runs of letters, of digits, of other signs) fall into BUCKETS buckets by hash. Each bucket has a
random index vector of a few +1 and -1, fixed by a seed, and a context vector: the sum of the index vectors
of the two tokens on either side of each of its occurrences, counted over the whole corpus. Partial sums of
tasks are added up by blocks of buckets in a tree, of which a task adds TREE partial sums of a block, so that there
are as many tasks as the input needs; the driver holds the finished table (BUCKETS x DIMS numbers, whatever the
corpus). Sums are of integers and don't depend on order.

A document is the mean of its tokens' context and index vectors. Three marks count as tokens of their own:
a word in capitals, a repeat of the token before, a token that the document had before. A tanh layer and
a logistic output are fitted in numpy on at most TRAIN_ROWS labelled documents (those of the smallest hash
of doc_id); a temperature, fitted on a fifth of them that training doesn't see, calibrates the probability.

Null and empty texts have the zero vector and get a score from it like any other. Labels that are null or
whose document is missing teach nothing; repeated labels of one document count once (the largest), and of rows
that repeat a doc_id one teaches (the smallest hash of its text), so the bound is one of rows. Of equal hashes the
smaller doc_id comes first. Repeated rows are scored each on its own, texts of any length whole; other columns,
whatever their names, are not read by report() and stay as they are in keep(). Without both classes among the
labels the score is the share of label 1 (0.5 without labels). No documents: no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm import words
from palisade.llm.common import crc_mod, partitions, prepare, record, slices, texts, trimmed

BUCKETS, DIMS, SEED, MARKS = 1 << 14, 64, 20241, 3
#: Labelled documents that the network is fitted on, at most.
TRAIN_ROWS = 20_000
THRESHOLD = 0.3
#: Buckets of a block of the table of context vectors, as it is shuffled.
BLOCK = 512
#: Partial sums of a block that one task of the tree adds up.
TREE = 64
#: Kinds of bytes: 0 white space, 1 letters, 2 digits, 3 other signs; whether one is of A-Z, of a-z. Bytes of text that are looked at
#: at a time, pairs of tokens that are counted at a time.
KINDS = np.array([0 if c in b" \t\n\r\f\v" else 1 if c >= 128 or chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(256)], dtype=np.uint8)
UPPER, LOWER = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
TEXTS, PAIRS = 1 << 20, 1 << 22


#: The rule of tokens and of their buckets one at a time; tokens() goes by it for many.
TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")


def bucket(token: bytes) -> int:
    """The token's bucket, plus BUCKETS for words in capitals."""
    low = token.lower()
    return MARKS + zlib.crc32(low) % (BUCKETS - MARKS) + BUCKETS * (len(token) > 1 and token != low and token == token.upper())


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each token's bucket, plus BUCKETS for words in capitals, text after text, and where each text's begin (and the last one's
    end)."""
    data = b"\n".join(texts)
    raw = np.frombuffer(data, np.uint8)
    begin, end = words.runs(KINDS[raw])
    size = end - begin
    ids = MARKS + words.crc32s(data.lower(), begin, size).astype(np.int64) % (BUCKETS - MARKS)
    if len(begin):
        # a stretch of sums from a token's begin to the next one's is the token's: what lies between are spaces
        high, low = (np.add.reduceat(of[raw], begin, dtype=np.int64) for of in (UPPER, LOWER))
        ids += BUCKETS * ((size > 1) & (high > 0) & (low == 0))
    starts = np.cumsum([0] + [len(x) + 1 for x in texts])
    return ids, np.searchsorted(begin, starts)


def index_vectors() -> np.ndarray:
    """Four nonzero places of each bucket's index vector: places (BUCKETS, 4); signs go +, -, +, -."""
    return np.random.default_rng(SEED).integers(0, DIMS, (BUCKETS, 4))


SIGNS = np.array([1, -1, 1, -1])


def index_table() -> np.ndarray:
    out = np.zeros((BUCKETS, DIMS), dtype=np.float32)
    for k, places in enumerate(index_vectors().T):
        np.add.at(out, (np.arange(BUCKETS), places), SIGNS[k])
    return out


def context_vectors(docs: DataFrame) -> np.ndarray:
    """The (BUCKETS, DIMS) sums of index vectors around each bucket's tokens, over all of docs."""
    prepare(docs.sparkSession)
    schema = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("sums", pa.binary())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, total, keys = index_vectors(), np.zeros(BUCKETS * DIMS, dtype=np.int64), []

        def add_up() -> None:
            # each pair of buckets once, with how often it came
            both = np.sort(np.concatenate(keys))
            at = np.flatnonzero(np.diff(both, prepend=-1))
            times, (one, two) = np.diff(np.append(at, len(both))), np.divmod(both[at].astype(np.int64), BUCKETS)
            for a, b in ((one, two), (two, one)):
                for k, sign in enumerate(SIGNS):
                    total[:] += np.bincount(a * DIMS + places[b, k], sign * times, len(total)).astype(np.int64)
            keys.clear()

        for batch in slices(batches, TEXTS):
            t, bounds = tokens(texts(batch))
            t, of = t % BUCKETS, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            for shift in (1, 2):
                one, two = (x[of[:-shift] == of[shift:]] for x in (t[:-shift], t[shift:]))
                keys.append((np.minimum(one, two) * BUCKETS + np.maximum(one, two)).astype(np.int32))
            if sum(map(len, keys)) > PAIRS:
                add_up()
        if keys:
            add_up()
        rows = total.reshape(-1, BLOCK * DIMS)
        some = np.nonzero(rows.any(axis=1))[0]
        if len(some):
            yield record(schema, some.astype(np.int32), [TaskContext.get().partitionId()] * len(some), [rows[k].astype("<i8").tobytes() for k in some])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for block, part, raw in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "sums"))):
                sums[block, part] = sums.get((block, part), 0) + np.frombuffer(raw, "<i8")
        for (block, part), x in sums.items():
            yield record(schema, [block], [part], [x.astype("<i8").tobytes()])

    kind = "block int, part int, sums binary"
    sums, width = docs.select("text").mapInArrow(trimmed(gather), kind), partitions(docs)
    while True:
        last, width = width <= TREE, max(1, -(-width // TREE))
        mine = F.lit(0) if last else F.pmod("part", F.lit(width))
        sums = sums.withColumn("part", mine.cast("int")).repartition(BUCKETS // BLOCK * (1 if last else width), "block", "part").mapInArrow(add, kind)
        if last:
            break
    out = np.zeros((BUCKETS // BLOCK, BLOCK * DIMS), dtype=np.int64)
    for row in sums.collect():
        out[row.block] += np.frombuffer(row.sums, "<i8")
    return out.reshape(BUCKETS, DIMS)


def word_vectors(contexts: np.ndarray) -> np.ndarray:
    """Unit context vectors beside index vectors."""
    norm = np.linalg.norm(contexts.astype(np.float64), axis=1, keepdims=True)
    out = np.hstack([contexts / np.maximum(norm, 1), index_table()]).astype(np.float32)
    # marks have a place of their own in the table
    out[:MARKS] = 0
    out[np.arange(MARKS), np.arange(MARKS) + DIMS] = 8
    return out


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """A row of each text."""
    ids, bounds = tokens(texts)
    out = np.zeros((len(texts), vectors.shape[1] + 1), dtype=np.float32)
    of = np.repeat(np.arange(len(texts)), np.diff(bounds))
    capital, t = ids >= BUCKETS, ids % BUCKETS
    # each text's buckets, ascending
    keys = np.sort(of * BUCKETS + t)
    at = np.flatnonzero(np.diff(keys, prepend=-1))
    counts, kinds = np.diff(np.append(at, len(keys))).astype(np.float32), keys[at] % BUCKETS
    cut = np.searchsorted(at, bounds)
    capitals = np.bincount(of, capital, len(texts))
    again = np.bincount(of[1:], (t[1:] == t[:-1]) & (of[1:] == of[:-1]), len(texts))
    for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
        n = int(bounds[k + 1] - bounds[k])
        if n:
            out[k, :-1] = counts[a:b] @ vectors[kinds[a:b]]
            out[k, :-1] += np.array([capitals[k], again[k], n - (b - a)], dtype=np.float32) @ vectors[:MARKS]
            out[k] /= n
            out[k, -1] = np.log1p(n)
    return out


class Network:
    """Standardised inputs, a tanh layer, a logistic output over a temperature."""

    def __init__(self, seed: int = SEED, hidden: int = 24) -> None:
        self.seed, self.hidden, self.constant, self.temperature = seed, hidden, None, 1.0

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 0.01, decay: float = 1e-3) -> Network:
        if len(np.unique(y)) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        rng = np.random.default_rng(self.seed)
        order = rng.permutation(len(y))
        held, own = order[: len(y) // 5], order[len(y) // 5 :]
        if len(np.unique(y[own])) < 2:
            held, own = order[:0], order
        self.mean, self.scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-6
        n = x.shape[1]
        w = [rng.normal(0, n**-0.5, (n, self.hidden)), np.zeros(self.hidden), rng.normal(0, self.hidden**-0.5, self.hidden), np.zeros(1)]
        m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        z = (x - self.mean) / self.scale
        for epoch in range(epochs):
            own = rng.permutation(own)
            for at in range(0, len(own), batch):
                i = own[at : at + batch]
                h = np.tanh(z[i] @ w[0] + w[1])
                d = (1 / (1 + np.exp(-(h @ w[2] + w[3]))) - y[i]) / len(i)
                g2 = np.outer(d, w[2]) * (1 - h * h)
                grads = [z[i].T @ g2 + decay * w[0], g2.sum(axis=0), h.T @ d + decay * w[2], np.array([d.sum()])]
                step += 1
                for k, g in enumerate(grads):
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    lr = rate * (1 - epoch / epochs)
                    w[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.w = w
        if len(held):
            logits = self.logits(x[held])
            loss = lambda t: np.mean(np.logaddexp(0, logits / t) - y[held] * logits / t)
            self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.tanh(z @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-self.logits(x.astype(np.float64)) / self.temperature))


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn, most: int) -> DataFrame:
    """doc_id, text and label of at most `most` labelled documents for which `learn` holds: those whose doc_id has
    the smallest hash, one row each. What is broadcast is their ids and labels, `most` at the most."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn)
        .groupBy("doc_id")
        .agg(F.max(label).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # a doc_id of very many rows comes down to one in the tasks
    return rows.groupBy("doc_id", F.col("label").cast("double").alias("label")).agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "label")


def features(docs: DataFrame, vectors) -> DataFrame:
    """doc_id, label, x (float32s) of labelled documents."""
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.float64()), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, TEXTS):
            rows = [x.tobytes() for x in pooled(texts(batch), vectors.value)]
            yield record(schema, batch.column("doc_id").cast(pa.int64()), batch.column("label"), rows)

    return docs.mapInArrow(run, "doc_id long, label double, x binary")


class Model:
    def __init__(self, vectors: np.ndarray, network: Network) -> None:
        self.vectors, self.network = vectors, network

    def score(self, raw: list[bytes]) -> np.ndarray:
        if not raw:
            return np.zeros(0)
        return self.network.predict(pooled(raw, self.vectors))


def fit(docs: DataFrame, labels: DataFrame, learn=None, most: int = TRAIN_ROWS) -> Model:
    """Fits on docs and labels; `learn` is a condition on doc_id (by default that of the held-out fold)."""
    spark = docs.sparkSession
    learn = crc_mod(5) != 0 if learn is None else learn
    vectors = word_vectors(context_vectors(docs))
    shared = spark.sparkContext.broadcast(vectors)
    rows = sorted(features(labelled(docs, labels, "quality", learn, most), shared).collect())
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows], dtype=np.float64).reshape(len(rows), vectors.shape[1] + 1)
    return Model(vectors, Network().fit(x, np.array([r.label for r in rows])))


def report(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, TEXTS):
            yield record(schema, batch.column("doc_id").cast(pa.int64()), shared.value.score(texts(batch)))

    scored = docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, score double")
    return scored.select("doc_id", (crc_mod(5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs, with all columns, of a score of at least the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, TEXTS):
            yield batch.filter(pa.array(shared.value.score(texts(batch)) >= threshold))

    return docs.mapInArrow(trimmed(run), docs.schema)
