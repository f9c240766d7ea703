"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words of labelled documents whose share among toxic ones stands out (G-squared),
in a strong tier and a weak one, and stems of words, for words that are inflected. Near copies (verified, of one
class) teach once.
Features are densities of the tiers and stems, proximity of lexicon words to the
second person, rates of capitals, punctuation and obfuscation (signs or digits inside words, stretched
letters; an obfuscated word is looked up in its plain form too), and length. Trees are grown on histograms
in numpy by second-order boosting on at most TRAIN_ROWS labelled documents; pool-adjacent-violators on a
fifth of them, which the trees don't see, calibrates the probability.

Null and empty texts have zero features and get the score of those. Labels that are null or whose document
is missing teach nothing; of repeated labels the largest counts, of rows that repeat a doc_id the one of the smallest
hash of its text. Repeated rows are scored each on its own, texts of any length whole; equal scores need no order.
doc_id is a number; columns other than doc_id and text are not read, whatever their names. Without both classes
among the labels the score is the share of label 1 (0.5 without labels). No documents: no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import crc_mod, prepare, record, slices, texts
from palisade.llm.quality import labelled

TRAIN_ROWS = 10_000
THRESHOLD = 0.3
#: Words of the learned lexicon, at most.
LEXICON = 400
REMEMBERED = 150_000
#: The second person in the languages that the corpus has.
SECOND_PERSON = frozenset(b.encode() for b in "you your yours yourself du dich dir dein deine euch ihr tu te toi ton ta vous votre vos usted ustedes tus ti".split())
#: Signs that stand for letters.
STANDS_FOR = bytes.maketrans(b"013457@$!", b"oieastasi")
LETTERS = re.compile(rb"[^a-z\x80-\xff]+")
STRETCHED = re.compile(rb"(.)\1{2,}")
NEAR = 5
#: Lengths of stems, in letters.
STEMS = (4, 5, 6)
FEATURES = 16
#: Near copies: words of a run, the Jaccard index that makes a copy, and the minima that propose pairs.
SHINGLE, LIKE, BANDS, BAND = 5, 0.8, 16, 4
_FACTORS = np.random.default_rng(5).integers(1 << 62, size=BANDS * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def plain(token: bytes) -> bytes:
    """Lower case, without signs at either end."""
    return token.lower().strip(b" \t\n!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789")


def forms(token: bytes) -> tuple[bytes, bytes | None]:
    """The plain form of a token, and what it may hide: signs read as letters or left out, letters not stretched."""
    low = plain(token)
    hidden = None
    if low and not low.isalpha() and low.isascii():
        hidden = LETTERS.sub(b"", low.translate(STANDS_FOR))
    if STRETCHED.search(low):
        hidden = STRETCHED.sub(rb"\1", hidden or low)
    return low, hidden


def stems(word: bytes) -> list[bytes]:
    """The first letters of a longer word, marked by an asterisk."""
    letters = word.decode("utf-8", "replace")
    return [letters[:n].encode() + b"*" for n in STEMS if len(letters) > n]


class Lexicon:
    def __init__(self, strong: set[bytes], weak: set[bytes], stem: set[bytes]) -> None:
        self.strong, self.weak, self.stem = strong, weak, stem
        self.known: dict[bytes, int] = {}

    def __reduce__(self):
        return Lexicon, (self.strong, self.weak, self.stem)

    def code(self, token: bytes) -> int:
        """Bits: strong, weak, second person, found in a hidden form, obfuscated, capitals, stem."""
        low, hidden = forms(token)
        out = (low in self.strong) | (low in self.weak) << 1 | (low in SECOND_PERSON) << 2
        if hidden and not out & 1 and hidden in self.strong:
            out |= 1 | 8
        if self.stem and any(s[:-1] in self.stem for s in stems(low)):
            out |= 64
        return out | bool(hidden) << 4 | (len(low) > 1 and token == token.upper() and low.upper() != low) << 5

    def features(self, text: bytes) -> np.ndarray:
        out = np.zeros(FEATURES)
        found = text.split()
        if not found:
            return out
        if len(self.known) > REMEMBERED:
            self.known.clear()
        get = self.known.get
        codes = [get(t) for t in found]
        if None in codes:
            for k, c in enumerate(codes):
                if c is None:
                    codes[k] = self.known[found[k]] = self.code(found[k])
        c, n = np.array(codes), len(codes)
        share = lambda bit: float((c >> bit & 1).sum()) / n
        strong, you = np.nonzero(c & 1)[0], np.nonzero(c & 4)[0]
        near = 0
        if len(strong) and len(you):
            at = np.searchsorted(you, strong)
            before = strong - you[np.maximum(at - 1, 0)]
            after = you[np.minimum(at, len(you) - 1)] - strong
            near = int(((np.abs(before) <= NEAR) | (np.abs(after) <= NEAR)).sum())
        size = len(text)
        raw = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        out[:] = (
            share(0), math.log1p(len(strong)), share(1), math.log1p(int((c >> 1 & 1).sum())), near / n, share(2),
            raw[65:91].sum() / size, share(5), (raw[33:48].sum() + raw[58:65].sum()) / size, raw[33] / size,
            share(4), share(3), math.log1p(n), share(6), math.log1p(int((c >> 6 & 1).sum())),
            len({t for t, k in zip(found, codes) if k & 64}) / n,
        )
        return out


def shingles(text: bytes) -> np.ndarray:
    """Distinct hashes of a text's runs of SHINGLE words, or of all its words where they are fewer."""
    w = text.split()
    runs = {b" ".join(w[k : k + SHINGLE]) for k in range(max(1, len(w) - SHINGLE + 1))}
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(r) for r in runs), np.uint64, len(runs)))


def bands(found: np.ndarray) -> list[int]:
    """BANDS hashes of BAND minima each: texts of Jaccard 0.8 share one at least in all but 2 of 10,000 cases."""
    least = np.full(BANDS * BAND, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        mixed = found[at : at + 4096, None] * _FACTORS
        least = np.minimum(least, (mixed ^ mixed >> np.uint64(29)).min(axis=0))
    return [xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63) for x in least.reshape(BANDS, BAND)]


def copies(docs: DataFrame) -> DataFrame:
    """The labelled documents (doc_id, text, label) without near copies: a row is left out only if a row of its
    class that stays, earlier by doc_id, has Jaccard LIKE or more to it in runs of words. Bands of minima only
    propose the pairs: each row of a band with the band's first. Rows that are equal altogether stay once."""
    row = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"))
    rows = docs.distinct().select("doc_id", "text", "label", row.alias("row")).checkpoint()
    signs = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("label", pa.float64()), ("band", pa.int32()), ("sign", pa.int64())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [np.repeat(batch.column(c).to_numpy(zero_copy_only=False), BANDS) for c in ("doc_id", "h", "label")]
            found = [x for t in texts(batch) for x in bands(shingles(t))]
            yield record(signs, *own, np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows), found)

    signed = rows.select("doc_id", "row.h", "label", "text").mapInArrow(sign, "doc_id long, h long, label double, band int, sign long")
    signed = signed.select(F.struct("doc_id", "h").alias("row"), "label", "band", "sign").checkpoint()
    key = ["label", "band", "sign"]
    first = signed.groupBy(*key).agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = signed.join(F.broadcast(first), key).where(F.col("row") > F.col("first")).select("row", "first").distinct()
    like = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("first_id", pa.int64()), ("first_h", pa.int64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            same = []
            for a, b in zip(texts(batch), texts(batch, "other")):
                x, y = shingles(a), shingles(b)
                both = len(np.intersect1d(x, y, assume_unique=True))
                same.append(both >= LIKE * (len(x) + len(y) - both))
            yield batch.select(like.names).filter(pa.array(same, pa.bool_()))

    # the pairs' first rows are few next to the rows: a hot one meets its copies in a join, which AQE splits
    both = rows.select("row", "text").join(F.broadcast(pairs), "row")
    both = both.join(rows.select(F.col("row").alias("first"), F.col("text").alias("other")), "first")
    both = both.select("row.doc_id", "row.h", F.col("first.doc_id").alias("first_id"), F.col("first.h").alias("first_h"), "text", "other")
    found = both.mapInArrow(verify, "doc_id long, h long, first_id long, first_h long")
    found = found.select(F.struct("doc_id", "h").alias("row"), F.struct(F.col("first_id").alias("doc_id"), F.col("first_h").alias("h")).alias("first")).checkpoint()
    stays = found.join(F.broadcast(found.select(F.col("row").alias("first")).distinct()), "first", "left_anti")
    return rows.join(F.broadcast(stays.select("row").distinct()), "row", "left_anti").select("doc_id", "text", "label")


def learn_lexicon(docs: DataFrame, most: int = LEXICON) -> Lexicon:
    """From labelled documents (doc_id, text, label): words and stems (first letters of longer words) are
    counted by document and class in the tasks and added up in Spark; only those that stand out, `most` at
    the most, come to the driver."""
    schema = pa.schema([("word", pa.binary()), ("a", pa.int64()), ("b", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()
        for batch in slices(batches):
            for text, label in zip(texts(batch), batch.column("label").to_pylist()):
                found = {w for w in map(plain, set(text.split())) if 2 < len(w) < 40}
                found |= {s for w in found for s in stems(w)}
                seen[label < 0.5].update(found)
        every = list(seen[0].keys() | seen[1].keys())
        for at in range(0, len(every), 50_000):
            part = every[at : at + 50_000]
            yield record(schema, part, [seen[0][w] for w in part], [seen[1][w] for w in part])

    totals = {r.label: float(r.n) for r in docs.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pos, neg = totals.get(1.0, 0), totals.get(0.0, 0)
    if not pos or not neg:
        return Lexicon(set(), set(), set())
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    n, k = pos + neg, a + b
    term = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    g = 2 * (term(a, k * pos / n) + term(b, k * neg / n) + term(pos - a, pos - k * pos / n) + term(neg - b, neg - k * neg / n))
    ranked = (
        docs.coalesce(8)
        .mapInArrow(count, "word binary, a long, b long")
        .groupBy("word")
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        .where((a >= 3) & (a / pos > 2 * b / neg))
        .withColumn("g", g)
        .where(F.col("g") > 20)
        .orderBy(F.desc("g"), "word")
        .limit(most)
        .collect()
    )
    top = max((r.g for r in ranked if not r.word.endswith(b"*")), default=0)
    words = [(bytes(r.word), r.g) for r in ranked if not r.word.endswith(b"*")]
    chosen: list[bytes] = []
    for r in ranked:
        stem = bytes(r.word)
        if stem.endswith(b"*") and not any(c.startswith(stem[:-1]) or stem[:-1].startswith(c) for c in chosen):
            chosen.append(stem[:-1])
    strong = {w for w, g in words if g >= 0.25 * top}
    return Lexicon(strong, {w for w, _ in words} - strong, set(chosen))


class Trees:
    """Logistic boosting with histogram trees of fixed depth."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = []
        for col in x.T:
            values = np.unique(col)
            some = values if len(values) <= self.bins else np.unique(np.quantile(values, np.linspace(0, 1, self.bins + 1)))
            self.cuts.append((some[1:] + some[:-1]) / 2)
        binned = self.binned(x)
        width = self.bins + 2
        prior = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(prior / (1 - prior)))
        f = np.full(len(y), self.base)
        self.trees = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            grad, hess = p - y, p * (1 - p)
            node = np.zeros(len(y), dtype=np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, width, np.int64)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                best = np.full(count, 1e-6)
                for j in range(x.shape[1]):
                    key = node * width + binned[:, j]
                    g = np.bincount(key, grad, count * width).reshape(count, width).cumsum(axis=1)
                    h = np.bincount(key, hess, count * width).reshape(count, width).cumsum(axis=1)
                    gr, hr = g[:, -1:] - g, h[:, -1:] - h
                    gain = g**2 / (h + self.l2) + gr**2 / (hr + self.l2) - g[:, -1:] ** 2 / (h[:, -1:] + self.l2)
                    gain[(h < 1) | (hr < 1)] = 0
                    at = gain.argmax(axis=1)
                    value = gain[np.arange(count), at]
                    better = value > best
                    best[better] = value[better]
                    feature[first : first + count][better], cut[first : first + count][better] = j, at[better]
                k = first + node
                node = 2 * node + (binned[np.arange(len(y)), feature[k]] > cut[k])
            g, h = np.bincount(node, grad, 2**self.depth), np.bincount(node, hess, 2**self.depth)
            leaf = -self.rate * g / (h + self.l2)
            f += leaf[node]
            self.trees.append((feature, cut, leaf))
        return self

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(self.cuts)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, rows = self.binned(x), np.arange(len(x))
        f = np.full(len(x), self.base)
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for level in range(self.depth):
                k = 2**level - 1 + node
                node = 2 * node + (b[rows, feature[k]] > cut[k])
            f += leaf[node]
        return f


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: ascending x values and the probability at each, each pool drawn a little to
    the overall share so that none is 0 or 1."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for xi, yi in zip(x[order], y[order]):
        pools.append([yi, 1.0, xi, xi])
        while len(pools) > 1 and (pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1] or pools[-2][3] == pools[-1][2]):
            s, n, _, hi = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2], hi]
    share = y.mean()
    xs = np.array([v for p in pools for v in (p[2], p[3])])
    ps = np.array([(p[0] + share) / (p[1] + 1) for p in pools for _ in (0, 1)])
    return xs, np.maximum.accumulate(ps)


class Model:
    def __init__(self, lexicon: Lexicon, x: np.ndarray, y: np.ndarray, seed: int = 7) -> None:
        self.lexicon, self.constant = lexicon, None
        if len(np.unique(y)) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        order = np.random.default_rng(seed).permutation(len(y))
        held, own = order[: len(y) // 5], order[len(y) // 5 :]
        if len(np.unique(y[own])) < 2 or len(np.unique(y[held])) < 2:
            held, own = order, order
        self.trees = Trees().fit(x[own], y[own])
        self.steps = isotonic(self.trees.margin(x[held]), y[held])

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return np.interp(self.trees.margin(x), *self.steps)

    def score(self, raw: list[bytes]) -> np.ndarray:
        return self.predict(np.array([self.lexicon.features(t) for t in raw]).reshape(len(raw), FEATURES))


def fit(docs: DataFrame, labels: DataFrame, learn=None, most: int = TRAIN_ROWS) -> Model:
    prepare(docs.sparkSession)
    learn = crc_mod(4) != 2 if learn is None else learn
    rows = copies(labelled(docs, labels, "toxic", learn, most).checkpoint()).checkpoint()  # at most `most` documents
    lexicon = learn_lexicon(rows)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.float64()), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield record(schema, batch.column("doc_id").cast(pa.int64()), batch.column("label"), [shared.value.features(t).tobytes() for t in texts(batch)])

    got = sorted(rows.mapInArrow(run, "doc_id long, label double, x binary").collect())
    x = np.array([np.frombuffer(r.x) for r in got]).reshape(len(got), FEATURES)
    return Model(lexicon, x, np.array([r.label for r in got]))


def report(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per row of docs."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield record(schema, batch.column("doc_id").cast(pa.int64()), shared.value.score(texts(batch)))

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (crc_mod(4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
