"""Token ids in binary shards with a minimal perfect hash index from document keys to offsets.

Documents are range-partitioned by doc_id, so shard k holds smaller ids than shard k + 1, and each shard
is written by one task: an `.ids` file, the raw little-endian ids of its documents one after another
(unsigned 16 or 32 bits, as the vocabulary needs), and an `.idx` file:

    magic PLSDTOK2, then int64s: bytes of an id, rows, rows with a null key, distinct keys, levels;
    sizes     int64 for each level: blocks of its bitmap
    blocks    of all levels, BLOCK_BYTES each: int64 count of the bits before the block, then 512 bits
    entries   ENTRY_BYTES for each distinct key, by its perfect hash: uint32 fingerprint of the key, uint32 rows
              of it, int64 its first row
    offsets   int64 for each row and one more: first id of the row in the shard

The index is a cascade of bitmaps: a key that alone hashes to a bit of a level owns it, the others go on
to the next level; the rank of the bit is the key's number. Keys themselves are not stored. The directory (one
entry a shard, with its smallest and largest key) names the shard of a key; a lookup there seeks to a block for
each level that it passes (two or three), an entry, the row's offsets and its ids: constant time, whatever the
shard holds. A key that is not in the shard is refused by its fingerprint but for one in 2**32. Reading many
keys loads blocks and entries of a shard once.

A task writes under a name of its own attempt; the directory lists the attempts that counted, so a repeated or
doubled task does no harm. Documents with one doc_id are separate rows in order of their text, null ids come
first; a doc_id of very many rows may go on in several shards (there, rows whose texts begin alike go as they
come). A null or empty text is a document of the end id alone. doc_id is a number; other columns are not read.
Texts of any length are encoded whole. No documents: no shards.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import partitions, prepare, record, shared_path, slices

END_ID = 1
MAGIC = b"PLSDTOK2"
HEAD, BLOCK_BYTES = len(MAGIC) + 5 * 8, 72
ENTRY = np.dtype([("print", "<u4"), ("count", "<u4"), ("row", "<i8")])
ENTRY_BYTES = ENTRY.itemsize
#: The text rules for which pieces between white space may be encoded each on its own.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Pieces of text that a worker remembers with their ids.
REMEMBERED = 500_000
#: ASCII without apostrophes, which the pre-tokenizer cuts by a rule of their own; its words.
PLAIN = re.compile(rb"[!-&(-~]+")
WORDS = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")
_U = np.uint64


def mix(keys: np.ndarray, salt: int) -> np.ndarray:
    """splitmix64 of keys under a salt."""
    z = keys.astype(np.int64).view(np.uint64) + _U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1 << 20) >> _U(32)).astype(np.uint32)


class PerfectHash:
    """Numbers distinct int64 keys 0 to n - 1. Levels are whole blocks of 512 bits."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray) -> None:
        self.sizes, self.words = sizes.astype(np.int64), words.astype(np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, bits, left = [], [], keys
        while len(left):
            size = -(-2 * len(left) // 512) * 512
            at = (mix(left, len(sizes)) % _U(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left = left[~alone[at]]
        packed = np.packbits(np.concatenate(bits), bitorder="little").view("<u8") if bits else np.zeros(0, "<u8")
        return cls(np.array(sizes, dtype=np.int64), packed)

    def number(self, keys: np.ndarray) -> np.ndarray:
        """-1 for keys that no level owns."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            bit = self.starts[level] + (mix(keys[left], level) % _U(size)).astype(np.int64)
            word, off = bit >> 6, (bit & 63).astype(np.uint64)
            own = (self.words[word] >> off & _U(1)).astype(bool)
            below = self.words[word] & ((_U(1) << off) - _U(1))
            out[left[own]] = (self.ranks[word] + np.bitwise_count(below).astype(np.int64))[own]
            left = left[~own]
        return out

    def blocks(self) -> np.ndarray:
        """Rows of nine words: the count of bits before a block, and the block."""
        return np.column_stack([self.ranks[:-1:8].astype(np.uint64), self.words.reshape(-1, 8)]).astype("<u8")


def index_bytes(keys: list[int | None], counts: np.ndarray, width: int) -> bytes:
    nulls = sum(k is None for k in keys)
    distinct, first, rows = np.unique(np.array(keys[nulls:], dtype=np.int64), return_index=True, return_counts=True)
    table = PerfectHash.build(distinct)
    entries = np.zeros(len(distinct), ENTRY)
    number = table.number(distinct)
    entries["print"][number], entries["count"][number], entries["row"][number] = fingerprint(distinct), rows, first + nulls
    head = np.array([width, len(keys), nulls, len(distinct), len(table.sizes)], dtype="<i8")
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype("<i8")
    return MAGIC + b"".join(x.tobytes() for x in (head, (table.sizes // 512).astype("<i8"), table.blocks(), entries, offsets))


class Shard:
    """A written shard, opened by its path without ending. `fs` is for paths that have no scheme of their own."""

    def __init__(self, path: str, fs: pyarrow.fs.FileSystem | None = None) -> None:
        self.fs, self.path = (fs, path) if fs else pyarrow.fs.FileSystem.from_uri(path)
        self.index = self.fs.open_input_file(f"{self.path}.idx")
        self.payload = self.fs.open_input_file(f"{self.path}.ids")
        head = self._at(0, HEAD)
        if head[:8] != MAGIC:
            raise ValueError(f"{path}.idx is no index of token ids")
        self.width, self.rows, self.nulls, self.distinct, levels = map(int, np.frombuffer(head, "<i8", 5, 8))
        self.sizes = np.frombuffer(self._at(HEAD, 8 * levels), "<i8")
        self.blocks_at = HEAD + 8 * levels
        self.entries_at = self.blocks_at + BLOCK_BYTES * int(self.sizes.sum())
        self.offsets_at = self.entries_at + ENTRY_BYTES * self.distinct

    def _at(self, place: int, size: int) -> bytes:
        self.index.seek(place)
        return self.index.read(size)

    def __enter__(self) -> Shard:
        return self

    def __exit__(self, *_: object) -> None:
        self.index.close()
        self.payload.close()

    def find(self, key: int) -> tuple[int, int]:
        """First row and number of rows of a key, by seeking; (-1, 0) where the shard doesn't have it."""
        keys, before = np.array([key], dtype=np.int64), 0
        for level, size in enumerate(self.sizes.tolist()):
            bit = int(mix(keys, level)[0] % _U(size * 512))
            words = np.frombuffer(self._at(self.blocks_at + BLOCK_BYTES * (before + bit // 512), BLOCK_BYTES), "<u8")
            word, off = bit % 512 // 64, bit % 64
            if int(words[1 + word]) >> off & 1:
                rank = int(words[0]) + int(np.bitwise_count(words[1 : 1 + word]).sum()) + (int(words[1 + word]) & (1 << off) - 1).bit_count()
                entry = np.frombuffer(self._at(self.entries_at + ENTRY_BYTES * rank, ENTRY_BYTES), ENTRY)[0]
                return (int(entry["row"]), int(entry["count"])) if entry["print"] == fingerprint(keys)[0] else (-1, 0)
            before += size
        return -1, 0

    def find_all(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """find() of many keys, from blocks and entries that are read once."""
        if not hasattr(self, "table"):
            words = np.frombuffer(self._at(self.blocks_at, self.entries_at - self.blocks_at), "<u8").reshape(-1, 9)
            self.table = PerfectHash(self.sizes * 512, words[:, 1:].ravel())
            self.entries = np.frombuffer(self._at(self.entries_at, self.offsets_at - self.entries_at), ENTRY)
        number = self.table.number(keys)
        ok = number >= 0
        ok[ok] = self.entries["print"][number[ok]] == fingerprint(keys[ok])
        row, count = np.full(len(keys), -1, dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        row[ok], count[ok] = self.entries["row"][number[ok]], self.entries["count"][number[ok]]
        return row, count

    def offsets(self, row: int, count: int) -> np.ndarray:
        """Where rows begin in the payload, and where the last of them ends."""
        return np.frombuffer(self._at(self.offsets_at + 8 * row, 8 * (count + 1)), "<i8")

    def ids(self, begin: int, end: int) -> np.ndarray:
        """The payload's ids from begin to before end."""
        self.payload.seek(begin * self.width)
        return np.frombuffer(self.payload.read((end - begin) * self.width), f"<u{self.width}")


class Pieces(dict):
    """A tokenizer of the tokenizers library behind a memory of pieces between ASCII white space, in lower
    case. For vocabularies whose normalizer and pre-tokenizer drop white space and case, a text's ids are those
    of its pieces, one after another. Runs of letters or of signs within an ASCII piece are words to the
    pre-tokenizer, so they go to the library's model as such; all else goes through the whole library, and so
    do texts in which a special token may be. With other rules than those, all texts go through the library."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        spec = json.loads(self.library.to_str())
        before = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_piece = (
            spec.get("normalizer") == NORMALIZER
            and [x.get("type") for x in before] == ["Split", "ByteLevel"]
            and (before[0]["pattern"], before[0]["behavior"], before[0]["invert"]) == ({"Regex": SPLIT}, "Removed", True)
            and not before[1]["add_prefix_space"]
            and not before[1]["use_regex"]
            and all("<|" in t["content"] for t in spec["added_tokens"])
        )
        self.before: dict[bytes, bytes] = {}  # what is used again outlives this
        self.width = 2 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4

    def packed(self, ids: list[int]) -> bytes:
        return array("H" if self.width == 2 else "I", ids).tobytes()

    def __missing__(self, piece: bytes) -> bytes:
        """Ids of a piece, which is remembered from now on."""
        out = self.before.get(piece)
        if out is not None:
            pass
        elif not PLAIN.fullmatch(piece):
            out = self.packed(self.library.encode(piece.decode(), add_special_tokens=False).ids)
        elif len(words := WORDS.findall(piece)) > 1:
            out = b"".join(map(self.__getitem__, words))
        else:
            out = self.packed([t.id for t in self.model.tokenize(piece.decode())])
        self[piece] = out
        return out

    def encode(self, texts: list[bytes], end_id: int) -> list[bytes]:
        if len(self) > REMEMBERED:
            self.before = dict(self)
            self.clear()
        end, get = self.packed([end_id]), self.__getitem__
        return [
            (self.packed(self.library.encode(x.decode(), add_special_tokens=False).ids) if b"<|" in x or not self.by_piece else b"".join(map(get, x.lower().split()))) + end
            for x in texts
        ]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, shards: int | None = None) -> list[dict]:
    """Writes docs' ids in shards under `path`; the directory of what each shard holds, in order (one entry a shard:
    shard, path, rows, nulls, first and last key, n_ids, start)."""
    spark = docs.sparkSession
    prepare(spark)
    shards = shards or partitions(docs)
    if path.startswith("file:") or "://" not in path:
        fs, local = pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        fs.create_dir(local)
    whole = ("rows", "nulls", "first", "last", "n_ids")
    schema = pa.schema([("shard", pa.int32()), ("path", pa.string()), *((c, pa.int64()) for c in whole)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, shard = pieces(tokenizer_path), TaskContext.get().partitionId()
        keys, counts = [], []
        base = f"{path}/{shard:05d}-{uuid.uuid4().hex}"
        fs, local = pyarrow.fs.FileSystem.from_uri(base)
        with fs.open_output_stream(f"{local}.ids") as out:
            for batch in slices(batches):
                keys += batch.column("doc_id").to_pylist()
                for x in t.encode(batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist(), end_id):
                    counts.append(len(x) // t.width)
                    out.write(x)
        if not keys:
            fs.delete_file(f"{local}.ids")
            return
        with fs.open_output_stream(f"{local}.idx") as out:
            out.write(index_bytes(keys, np.array(counts, dtype=np.int64), t.width))
        nulls = sum(k is None for k in keys)
        first, last = (keys[nulls], keys[-1]) if nulls < len(keys) else (LEAST, LEAST)
        yield record(schema, [shard], [base], [len(keys)], [nulls], [first], [last], [sum(counts)])

    # what is beside doc_id deals out a key of very many rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("n"))
    ordered = rows.repartitionByRange(shards, "doc_id", F.substring("text", 1, 64), "n").sortWithinPartitions("doc_id", "text", "n")
    made = sorted(ordered.mapInArrow(run, "shard int, path string, " + ", ".join(f"{c} long" for c in whole)).collect())
    out, start = [], 0
    for r in made:
        out.append(r.asDict() | {"start": start})
        start += r.n_ids
    return out


#: What stands for the keys of a shard that has none.
LEAST = -(1 << 63)


def read(spark: SparkSession, shards: list[dict], keys: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the documents of keys' doc_ids, found by lookups in the shards. Keys meet
    the shards that the directory names for them; keys that no document has give no rows."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], kind)
    directory = spark.sparkContext.broadcast([(s["path"], s["start"], s["nulls"], s["first"], s["last"]) for s in shards])
    place = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last = (np.array([s[k] for s in directory.value], dtype=np.int64) for k in (3, 4))
        some = [k for k, s in enumerate(directory.value) if s[2]]
        for batch in batches:
            ids = batch.column("doc_id")
            if ids.null_count:
                yield record(place, some, [None] * len(some))
            key = ids.drop_null().to_numpy()
            lo, hi = np.searchsorted(last, key), np.searchsorted(first, key, side="right")
            n = np.maximum(hi - lo, 0)
            shard = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            yield record(place, shard.astype(np.int32), np.repeat(key, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard, start = -1, None, 0
        out: list[tuple] = []
        for batch in batches:
            number, ids = batch.column("shard").to_numpy(), batch.column("doc_id")
            for k in np.unique(number).tolist():
                if k != own:
                    if shard:
                        shard.__exit__()
                    own, shard, start = k, Shard(directory.value[k][0]), directory.value[k][1]
                mine = ids.filter(pa.array(number == k))
                key = mine.drop_null().to_numpy()
                row, count = shard.find_all(key)
                found = list(zip(key.tolist(), row.tolist(), count.tolist()))
                if mine.null_count:
                    found.insert(0, (None, 0, shard.nulls))
                for doc_id, first, n in found:
                    for at in range(0, n, 10_000):
                        edges = shard.offsets(first + at, min(n - at, 10_000))
                        crc = [zlib.crc32(shard.ids(a, b).astype("<u4").tobytes()) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                        out.append((doc_id, edges[:-1] + start, np.diff(edges), crc))
            if out:
                every = [d for d, _, n, _ in out for _ in range(len(n))]
                yield record(schema, every, *(np.concatenate([o[c] for o in out]) for c in (1, 2, 3)))
                out.clear()
        if shard:
            shard.__exit__()

    # a key of very many rows is one key
    distinct = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    dealt = distinct.mapInArrow(deal, "shard int, doc_id long").repartition(len(shards), "shard").sortWithinPartitions("shard", "doc_id")
    return dealt.mapInArrow(run, kind)


def lookup(shards: list[dict], key: int, fs: pyarrow.fs.FileSystem | None = None) -> list[np.ndarray]:
    """The ids of the documents with this doc_id: the directory names the shard (of a key of very many rows, the
    shards), and what is read there doesn't grow with the shard."""
    out = []
    at = bisect_left(shards, key, key=lambda s: s["last"])
    while at < len(shards) and shards[at]["first"] <= key:
        with Shard(shards[at]["path"], fs) as shard:
            row, count = shard.find(key)
            edges = shard.offsets(row, count).tolist() if count else []
            out += [shard.ids(a, b) for a, b in zip(edges, edges[1:])]
        at += 1
    return out


def report(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Writes docs' ids under path (a new folder of the shared one if None) and reads them back by docs' keys."""
    spark = docs.sparkSession
    return read(spark, write(docs, path or shared_path(spark, "token-ids"), tokenizer_path), docs)
