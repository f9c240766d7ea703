"""Benchmark decontamination: a broadcast set of normalised test n-grams, scanned over documents.

Words are runs of digits, letters a-z (A-Z lower-cased) and bytes of non-ASCII characters. A window
is 13 consecutive words of an item; an item of fewer words is one window. The words of the benchmark
get ids; a document becomes a vector of ids (0: not a benchmark word), in which windows are found by
a rolling hash and every hit is verified id by id, so hash collisions never count.

The broadcast is checked: beyond MOST_WORDS benchmark words the benchmark is cut into blocks of about that
many words (long items in parts that overlap) and the documents are scanned once a block; hits are merged per document as position
runs, so the result is the same.

Nulls and empty texts have no words; they are neither hit nor hit anything. Repeated items with one id
count once, items with a null id hit words but are not listed. Rows of documents are judged each on its
own, so repeated doc_ids stay separate rows, and texts are judged whole whatever their length. Other columns,
whatever their names, stay as they are. An empty benchmark hits nothing; no documents give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from palisade.llm.common import named, prepare, renamed, slices, texts

WINDOW = 13
#: A document is contaminated if one in so many of its words is hit.
SHARE = 20
#: Words of one broadcast block (about 100 bytes each in a worker).
MOST_WORDS = 1_000_000
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def words(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


class Windows:
    """The windows of a block of items: ids of their words, hashes by length, items by window."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int = WINDOW) -> None:
        self.ids: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            w = [self.ids.setdefault(x, len(self.ids) + 1) for x in words(text)]
            for i in range(max(0, len(w) - window) + 1 if w else 0):
                found.setdefault(tuple(w[i : i + window]), set()).update([] if item_id is None else [str(item_id)])
        # splitmix64 of the id: what a word adds to a hash
        z = (np.arange(len(self.ids) + 1, dtype=np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15)
        z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        self.value = z ^ (z >> _U(27))
        self.value[0] = 0
        self.by_length = []
        for n in sorted({len(x) for x in found}):
            grams = [x for x in found if len(x) == n]
            m = np.array(grams, dtype=np.int64).reshape(-1, n)
            hashes = (self.value[m] * powers(n)[0]).sum(axis=1, dtype=np.uint64)
            order = np.argsort(hashes, kind="stable")
            self.by_length.append((n, hashes[order], m[order], [found[grams[i]] for i in order]))

    def scan(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
        """Which words are hit (all documents' words in a row), where documents begin, items by document."""
        get = self.ids.get
        flat: list[int] = []
        ends = np.zeros(len(docs) + 1, dtype=np.int64)
        for k, w in enumerate(docs):
            flat.extend([get(x, 0) for x in w])
            ends[k + 1] = len(flat)
        ids = np.array(flat, dtype=np.int64)
        cover = np.zeros(len(ids) + 1, dtype=np.int32)
        items: list[set[str]] = [set() for _ in docs]
        if not len(ids) or not ids.any():
            return cover[:-1] > 0, ends, items
        up, down = powers(len(ids))
        total = np.zeros(len(ids) + 1, dtype=np.uint64)
        np.cumsum(self.value[ids] * up, out=total[1:])
        zeros = np.zeros(len(ids) + 1, dtype=np.int64)
        np.cumsum(ids == 0, out=zeros[1:])
        for n, hashes, grams, owners in self.by_length:
            if n > len(ids):
                continue
            # only windows of benchmark words, within one document
            at = np.nonzero(zeros[n:] == zeros[:-n])[0]
            doc = np.searchsorted(ends, at, side="right") - 1
            inside = at + n <= ends[doc + 1]
            at, doc = at[inside], doc[inside]
            h = (total[at + n] - total[at]) * down[at]
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for i in np.nonzero(hi > lo)[0]:
                for g in range(lo[i], hi[i]):
                    if np.array_equal(ids[at[i] : at[i] + n], grams[g]):
                        cover[at[i]] += 1
                        cover[at[i] + n] -= 1
                        items[doc[i]] |= owners[g]
        return np.cumsum(cover[:-1]) > 0, ends, items


_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        m = max(n, 1 << 16)
        _powers = tuple(
            np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m - 1, b, np.uint64))])
            for b in (_BASE, _INVERSE)
        )
    return _powers[0][:n], _powers[1][:n]


def runs(hit: np.ndarray) -> tuple[list[int], list[int]]:
    """Begins and ends of the runs of true values."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist()


def without(text: bytes, begins: list[int], ends: list[int]) -> bytes:
    """The text without the spans of the words from begins[k] to before ends[k]."""
    at = [m.span() for m in WORD.finditer(text.lower())]
    out, last = [], 0
    for b, e in zip(begins, ends):
        out.append(text[last : at[b][0]])
        last = at[e - 1][1]
    return b"".join([*out, text[last:]])


def _blocks(benchmark: DataFrame, most: int, window: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """Items in blocks of about `most` words, one block on the driver at a time. An item of more goes in parts that
    have window - 1 words in common, so that each of its windows is in one."""
    block: list[tuple[int | None, bytes]] = []
    size = 0
    for item_id, text in benchmark.select("item_id", "text").distinct().toLocalIterator():
        w = words((text or "").encode())
        for at in range(0, max(len(w) - window + 1, 1), most):
            part = w[at : at + most + window - 1]
            if block and size + len(part) > most:
                yield block
                block, size = [], 0
            block.append((item_id, b" ".join(part)))
            size += len(part)
    yield block


FOUND = {"n_words": pa.int64(), "begins": pa.list_(pa.int32()), "ends": pa.list_(pa.int32()), "items": pa.list_(pa.string())}


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_words: int = MOST_WORDS) -> DataFrame:
    """docs with n_words, runs of hit words (begins, ends) and items (hit ones, as sorted strings). docs' own
    columns must not have these names.

    Beyond the first block, what rows carry so far is checkpointed and the block before is let go, so that a
    worker holds one block at a time."""
    spark = docs.sparkSession
    prepare(spark)
    out, before = docs, None
    for block in _blocks(benchmark, most_words, window):
        if before is not None:
            out = out.checkpoint()
            before.unpersist()
        before = spark.sparkContext.broadcast(Windows(block, window))
        out = _scan(out, before)
    return out


def _scan(docs: DataFrame, windows) -> DataFrame:
    """Adds a block's hits to those that rows already carry."""
    carried = "begins" in docs.columns
    own_columns = [c for c in docs.columns if c not in FOUND]
    names = [*own_columns, *FOUND]
    kind = docs.select(*own_columns).schema
    for name, t in FOUND.items():
        kind = kind.add(name, from_arrow_type(t))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            split = [words(x) for x in texts(batch)]
            hit, ends, items = windows.value.scan(split)
            begins_, ends_ = [], []
            old = [batch.column(c).to_pylist() for c in ("begins", "ends", "items")] if carried else None
            for k in range(len(split)):
                own = hit[ends[k] : ends[k + 1]]
                if old:
                    for b, e in zip(old[0][k], old[1][k]):
                        own[b:e] = True
                    items[k] |= set(old[2][k])
                b, e = runs(own)
                begins_.append(b)
                ends_.append(e)
            found = ([len(w) for w in split], begins_, ends_, [sorted(x) for x in items])
            columns = [batch.column(c) for c in own_columns]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(v, t) for v, t in zip(found, FOUND.values())], names=names)

    return docs.mapInArrow(scan, kind)


def n_hit():
    return F.coalesce(
        F.aggregate(F.zip_with("ends", "begins", lambda e, b: (e - b).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x),
        F.lit(0).cast("long"),
    )


def contaminated():
    return (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per row of docs."""
    found = hits(docs.select("doc_id", "text"), benchmark, **options).withColumn("n_hit", n_hit())
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "document", **options) -> DataFrame:
    """docs without contaminated documents (mode "document"), or all of them without the hit spans
    (mode "span"). All columns stay; a null text stays null."""
    found = hits(renamed(docs), benchmark, **options)
    if mode == "document":
        return named(found.withColumn("n_hit", n_hit()).where(~contaminated()), docs)
    kind = found.drop(*FOUND).schema

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            begins, ends = batch.column("begins").to_pylist(), batch.column("ends").to_pylist()
            new = [
                t if not b else without(t.encode(), b, e).decode("utf-8", "replace")
                for t, b, e in zip(batch.column("text").to_pylist(), begins, ends)
            ]
            columns = [pa.array(new, batch.schema.field("text").type) if c == "text" else batch.column(c) for c in kind.fieldNames()]
            yield pa.RecordBatch.from_arrays(columns, names=kind.fieldNames())

    return named(found.mapInArrow(clean, kind), docs)


def items_digest(items: list[str]) -> str:
    """The digest that report() gives for these items."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
