"""SentencePiece BPE with byte fallback, encoded by vectorised merge rounds.

A text gets a space in front, and spaces become the mark U+2581. It is cut into words, a run of marks and what
follows it, as no piece goes on over a mark that follows something else; and words are cut again between
characters that stand side by side in no piece. Nothing can be merged across such a cut.

The symbols of many words lie in one flat numpy array, characters at first, with the rank (by score) of the piece
that each symbol makes with the next of its word. In a round, each word's smallest rank is found by a segmented
minimum, and all its pairs of that rank are merged at once, leftmost first where they overlap; the array is compacted,
the ranks beside merged symbols are looked up again, and words without a pair leave. Rounds go on until no pair
remains. Where merging could make a pair that should come before the word's other pairs of that rank (pieces of equal
scores, such as runs of marks), only the word's leftmost pair is merged in a round. Runs of marks longer than two of
the longest such piece begin with that piece, whatever follows: those are split off at once, if the vocabulary is of
that kind. A word of more than LONG symbols keeps its pairs in a heap instead, in the same order, as rounds over
all of it would cost the square of its length.

Characters that are in no piece become the ids of their UTF-8 bytes. Decoding joins the pieces, marks as spaces,
without the first space; bytes that aren't UTF-8 become U+FFFD each. Words that come again are remembered.

A null or empty text has no ids. Repeated rows are encoded each on its own; texts of any length whole, a part at a
time. doc_id is a number or null; columns other than doc_id and text are not read, whatever their names. No documents:
no rows.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palisade.llm import bpe
from palisade.llm.bpe import BATCH, PIECE, Words, listed, ragged
from palisade.llm.common import prepare, record, slices

#: Fixed values of the model format: the mark of a space, kinds of pieces.
MARK, NORMAL, UNKNOWN, CONTROL, BYTE = "▁", 1, 2, 3, 6
#: Symbols of a word beyond which it goes alone.
LONG = 1 << 14
NEVER = np.int32(2**31 - 1)

codecs.register_error("each byte", lambda e: ("�", e.start + 1))


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = number()
        size = {0: 0, 1: 8, 5: 4}.get(key & 7)
        if size == 0:
            yield key >> 3, number()
            continue
        size = number() if size is None else size
        yield key >> 3, data[at : at + size]
        at += size


def read(path: str) -> list[tuple[str, float, int]]:
    """Pieces, scores and kinds of a model file; refuses one whose rules are not those that are followed here."""
    with open(path, "rb") as f:
        model = list(fields(f.read()))
    out, right = [], True
    for field, value in model:
        if field == 1:
            piece = dict(fields(value))
            out.append((piece[1].decode(), float(np.frombuffer(piece.get(2, bytes(4)), "<f4")[0]), piece.get(3, NORMAL)))
        elif field == 2:
            spec = dict(fields(value))
            right &= spec.get(3, 1) == 2 and not spec.get(24, 0) and spec.get(35, 0) == 1 and spec.get(44, " ⁇ ".encode()) == " ⁇ ".encode()
        elif field == 3:
            spec = dict(fields(value))
            right &= not spec.get(2, b"") and spec.get(3, 1) == 1 and not spec.get(4, 1) and spec.get(5, 1) == 1
    across = re.compile(f"[^{MARK}]{MARK}")
    right &= all(k in (NORMAL, UNKNOWN, CONTROL, BYTE) and not (k == NORMAL and across.search(p)) for p, _, k in out)
    right &= sum(k == BYTE for *_, k in out) == 256
    if not right:
        raise ValueError(f"{path} is no byte-fallback BPE with plain spaces: its rules are not those that are followed here")
    return out


class Merges:
    """The vocabulary, compiled. Symbols are numbered: pieces and characters of pieces; a character that is in none is
    the number of symbols and its code point. `keys` are pairs of symbols in order, `ranks` and `makes` what they come
    to; `loose` says whether a symbol, once made, may have a pair that comes no later than its own merge."""

    def __init__(self, vocabulary: list[tuple[str, float, int]]) -> None:
        pieces = {p: (i, s) for i, (p, s, kind) in reversed(list(enumerate(vocabulary))) if kind == NORMAL}
        names = [*pieces, *sorted({c for p in pieces for c in p} - pieces.keys())]
        self.number = number = {p: k for k, p in enumerate(names)}
        self.size = n = len(names)
        scores = np.array([pieces[p][1] if p in pieces else 0.0 for p in names])
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        self.bytes = np.zeros(256, np.int64)
        for i, (p, _, kind) in enumerate(vocabulary):
            if kind == BYTE:
                self.bytes[int(p[3:-1], 16)] = i
        self.names = names
        self.id = np.array([pieces[p][0] if p in pieces else -1 for p in names], dtype=np.int64)
        pairs = [(number[p[:k]], number[p[k:]], number[p]) for p in pieces for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        u, v, w = np.array(pairs, dtype=np.int64).reshape(-1, 3).T
        order = np.argsort(u * n + v)
        self.keys, self.makes = (u * n + v)[order], w[order].astype(np.int32)
        self.ranks = rank[self.makes]
        self.loose = np.zeros(n, dtype=bool)
        for side in (u, v):
            self.loose[side[rank[w] <= rank[side]]] = True
        # characters beside each other in a piece
        self.character = np.zeros(0x110000, dtype=np.int32) - 1
        self.character[[ord(c) for c in names if len(c) == 1]] = [number[c] for c in names if len(c) == 1]
        self.beside = np.unique(np.array([number[a] * n + number[b] for p in pieces for a, b in zip(p, p[1:])], dtype=np.int64))
        self.table = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.makes.tolist())))
        self.run = self._run(pieces, rank)

    def _run(self, pieces: dict[str, tuple[int, float]], rank: np.ndarray) -> int:
        """The length of the longest piece of marks alone, if long runs of marks begin with it: such pieces come after all
        others, no piece has several marks and something else, and a run of that length becomes that piece. Else 0."""
        runs = [p for p in pieces if len(p) > 1 and not p.strip(MARK)]
        if not runs or any(p[0] == p[1] == MARK and p.strip(MARK) for p in pieces if len(p) > 2):
            return 0
        longest = max(map(len, runs))
        last = max((rank[self.number[p]] for p in pieces if p.strip(MARK)), default=-1)
        one = self.alone(np.full(longest, self.number[MARK])) if MARK in self.number else []
        return longest if min(rank[self.number[p]] for p in runs) > last and len(one) == 1 else 0

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and symbols of pairs; NEVER where they make none."""
        key = np.where((left < self.size) & (right < self.size), left * np.int64(self.size) + right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], NEVER), np.where(found, self.makes[at], 0)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all of them."""
        texts = [w.decode() for w in words]
        ahead = np.zeros(len(texts), dtype=np.int64)  # runs of marks that go in front
        if self.run:
            for k, t in enumerate(texts):
                if t.startswith(MARK * (2 * self.run + 1)):
                    ahead[k] = (len(t) - len(t.lstrip(MARK)) - self.run - 1) // self.run
                    texts[k] = t[ahead[k] * self.run :]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        word = np.repeat(np.arange(len(texts)), sizes)
        symbol = self.character[points].astype(np.int64)
        symbol = np.where(symbol < 0, self.size + points, symbol)
        # cuts: between words and between characters that are side by side in no piece
        pair = np.where((symbol[:-1] < self.size) & (symbol[1:] < self.size), symbol[:-1] * self.size + symbol[1:], -1)
        joined = (word[1:] == word[:-1]) & np.isin(pair, self.beside)
        start = np.concatenate([[True], ~joined])[: len(symbol)]
        symbol, word = self._long(symbol, word, start)
        at, symbol = self._rounds(symbol, start=self.start)
        word = word[at]
        # ids: of a symbol, or of the bytes of a character
        spelled = self.id[np.minimum(symbol, self.size - 1)]
        spelled[symbol >= self.size] = -1
        if len(rare := np.nonzero(spelled < 0)[0]):
            as_bytes = [(chr(s - self.size) if s >= self.size else self.names[s]).encode() for s in symbol[rare].tolist()]
            counts = np.ones(len(symbol), dtype=np.int64)
            counts[rare] = list(map(len, as_bytes))
            ids = np.repeat(spelled, counts)
            ids[ids < 0] = self.bytes[np.frombuffer(b"".join(as_bytes), np.uint8)]
            word, spelled = np.repeat(word, counts), ids
        counts = np.bincount(word, minlength=len(texts)).astype(np.int64)
        if ahead.any():
            longest = self.id[self.number[MARK * self.run]]
            spelled = np.insert(spelled, np.repeat(np.cumsum(counts) - counts, ahead), longest)
            counts += ahead
        return counts, spelled

    def _long(self, symbol: np.ndarray, word: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and words with the long segments merged; `start` of what is left."""
        starts = np.append(np.nonzero(start)[0], len(symbol))
        over = np.nonzero(np.diff(starts) > LONG)[0]
        for k in over[::-1].tolist():
            a, b = starts[k], starts[k + 1]
            done = np.array(self.alone(symbol[a:b]), dtype=np.int64)
            symbol = np.concatenate([symbol[:a], done, symbol[b:]])
            word = np.concatenate([word[:a], np.full(len(done), word[a]), word[b:]])
            # nothing of it is merged any more
            start = np.concatenate([start[:a], np.ones(len(done), dtype=bool), start[b:]])
        self.start = start
        return symbol, word

    def alone(self, symbols: np.ndarray) -> list[int]:
        """One long word, by a heap of ranks and places."""
        n, table, size = len(symbols), self.table, self.size
        symbol = symbols.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, _ = self.look_up(symbols[:-1].astype(np.int64), symbols[1:].astype(np.int64))
        rank = [*ranks.tolist(), int(NEVER)]
        heap = [r << 32 | k for k, r in enumerate(rank) if r != NEVER]
        heapq.heapify(heap)

        def put(k: int) -> None:
            e = after[k]
            found = table.get(symbol[k] * size + symbol[e]) if e < n else None
            rank[k] = found[0] if found else int(NEVER)
            if found:
                heapq.heappush(heap, found[0] << 32 | k)

        while heap:
            top = heapq.heappop(heap)
            k = top & 0xFFFFFFFF
            if rank[k] != top >> 32:
                continue
            e = after[k]
            symbol[k] = table[symbol[k] * size + symbol[e]][1]
            rank[e], symbol[e] = -1, -1
            after[k] = after[e]
            if after[e] < n:
                before[after[e]] = k
            put(k)
            if before[k] >= 0:
                put(before[k])
        return [s for s in symbol if s >= 0]

    def _rounds(self, symbol: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges segments (each begins where `start` is true) until no pair remains: places of the symbols that are
        left, and these."""
        at, done_at, done = np.arange(len(symbol)), [], []
        rank, makes = self.look_up(symbol, np.append(symbol[1:], 0)) if len(symbol) else (np.zeros(0, np.int32), np.zeros(0, np.int32))
        rank[np.append(start[1:], True)[: len(rank)]] = NEVER
        while len(symbol):
            first = np.nonzero(start)[0]
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(symbol)))
            if (least == NEVER).any():
                out = np.repeat(least == NEVER, sizes)
                done_at.append(at[out])
                done.append(symbol[out])
                symbol, at, rank, makes, start = (x[~out] for x in (symbol, at, rank, makes, start))
                least, sizes = least[least != NEVER], sizes[least != NEVER]
                if not len(symbol):
                    break
                first = np.cumsum(sizes) - sizes
            sought = rank == np.repeat(least, sizes)
            places = np.nonzero(sought)[0]
            segment = np.searchsorted(first, places, side="right") - 1
            new = np.append(True, segment[1:] != segment[:-1])
            # where pairs overlap every other one is merged, from the left; of a loose symbol the leftmost pair only
            begins = np.append(True, (places[1:] != places[:-1] + 1)) | new
            run = np.maximum.accumulate(np.where(begins, np.arange(len(places)), 0))
            take = (np.arange(len(places)) - run) % 2 == 0
            loose = np.zeros(len(first), dtype=bool)
            np.logical_or.at(loose, segment, self.loose[makes[places]])
            take &= ~loose[segment] | new
            places = places[take]
            symbol[places] = makes[places]
            keep = np.ones(len(symbol), dtype=bool)
            keep[places + 1] = False
            moved = places - np.arange(len(places))  # where they are after compaction
            symbol, at, rank, makes, start = (x[keep] for x in (symbol, at, rank, makes, start))
            changed = np.zeros(len(symbol), dtype=bool)
            changed[moved], changed[moved[moved > 0] - 1] = True, True
            again = np.nonzero(changed)[0]
            follows = np.minimum(again + 1, len(symbol) - 1)
            r, m = self.look_up(symbol[again], symbol[follows])
            r[(again + 1 == len(symbol)) | start[follows]] = NEVER
            rank[again], makes[again] = r, m
        if not done:
            return at, symbol
        at, symbol = np.concatenate(done_at), np.concatenate(done)
        order = np.argsort(at)
        return at[order], symbol[order]


class Tokenizer(bpe.Tokenizer):
    """A model file; words are remembered as byte-level BPE remembers them."""

    def __init__(self, path: str) -> None:
        vocabulary = read(path)
        self.automaton = Merges(vocabulary)
        self.special: dict[str, int] = {}
        self.names = [str(i) for i in range(len(vocabulary))]
        self.labels = [{NORMAL: p.replace(MARK, " ").encode(), BYTE: bytes([int(p[3:-1], 16)]) if kind == BYTE else b"", UNKNOWN: " ⁇ ".encode()}.get(kind, b"") for p, _, kind in vocabulary]
        self.silent = {i for i, (*_, kind) in enumerate(vocabulary) if kind == CONTROL}
        self.spaced = {i for i, (p, _, kind) in enumerate(vocabulary) if kind == NORMAL and p.startswith(MARK)}
        self.split = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.gap = re.compile(f"(?<=[^{MARK}]){MARK}")
        self.words = Words()
        self.uses, self.starts, self.counts, self.ids = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int32))

    def pieces(self, text: str) -> Iterator[str]:
        """A text with its marks, in pieces of about PIECE characters, cut where a word begins."""
        if text:
            yield from super().pieces(MARK + text.replace(" ", MARK))

    def numbers(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        known, found = len(self.words.new), [self.split.findall(p) for p in pieces]
        numbers = np.fromiter((self.words[w] for f in found for w in f), np.int64, sum(map(len, found)))
        self.words.new[known:] = [w.encode() for w in self.words.new[known:]]
        return numbers, np.cumsum([0, *map(len, found)])

    @property
    def cut(self) -> None:
        return None

    def decode(self, ids: list[int]) -> str:
        out = b"".join(map(self.labels.__getitem__, ids))
        first = next((i for i in ids if i not in self.silent), None)
        return (out[1:] if first in self.spaced else out).decode("utf-8", "each byte")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """One for each worker process."""
    return Tokenizer(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids, one row per row of docs. The path is of a model file that every executor has."""
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in slices(batches, BATCH):
            yield record(schema, batch.column("doc_id").cast(pa.int64()), listed(t.encode_all([x or "" for x in batch.column("text").to_pylist()])))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and text from doc_id and ids; null ids make an empty text."""
    prepare(ids.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in slices(batches, BATCH):
            yield record(schema, batch.column("doc_id"), [t.decode(x or []) for x in batch.column("ids").to_pylist()])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, then decoded from the ids, one row per row."""
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        name = t.names.__getitem__
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in slices(batches, BATCH):
            found = [x.tolist() for x in t.encode_all([x or "" for x in batch.column("text").to_pylist()])]
            yield record(
                schema,
                batch.column("doc_id").cast(pa.int64()),
                list(map(len, found)),
                [sha(",".join(map(name, ids)).encode()) for ids in found],
                [sha(t.decode(ids).encode()) for ids in found],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
