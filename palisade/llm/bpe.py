"""Byte-level BPE through a compiled tokenization automaton.

The merge list is compiled by successive merge gadgets, in merge order. The automaton reads tokens; it
accepts exactly the token sequences that applying the merges in order can produce. It starts as one
state with an arc to itself for each byte. The gadget of merge u v -> w: the state that u leads to is
copied, the copy loses its arc v, arcs u now lead to the copy, and w gets arcs to where v led from the
old state (with u and v the same, the copy has neither v nor w). A copy's later gadgets don't touch what
it was copied from. A blocked v also blocks every token that is later built from v at its left end, as it
had no arc to build on; a token whose own gadget found no arc to build on has none anywhere.

Where a token leads is a state of its own, so states go by token. Tokens are numbered in post-order of the
tree of left parts, younger children last: then a gadget blocks one interval of arcs. The compiled table is
arrays: the sparse row of a state is its gadgets' disjoint intervals with the merge number of each, and its
tail is the row that it was copied from, that of its right part, of which it has what was compiled before it
was made. Rows are thus shared, not repeated: 50 thousand intervals for 50 thousand states in all, where a
full table of states by arcs would not fit.

The labels of arcs are bytes, so over bytes the automaton is not deterministic: it is made so by the subset
construction, as words are read. Every prefix of a word has one tokenization, so the subset that a walk is in
is one state for each place; a walk steps from place to place once, reads the table for all arcs that begin
there, and never backs out. Many words step together, in numpy. Decoding emits the labels of arcs.

Long texts are cut where white space begins, which no word goes across, so a worker holds the words of a
piece, not of a text. A null text is empty and has no ids. Repeated rows are encoded each on its own; columns
other than doc_id (a number) and text are not read, and without rows there is no output. A vocabulary file with
other rules than those compiled here is refused.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm import words
from palisade.llm.common import prepare, record, slices

#: The pattern by which byte-level BPE pre-splits, and white space as it sees it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Words that a worker remembers, characters of text that are split at a time, bytes of a batch, bytes of a word
#: beyond which it walks alone, words that walk together, pairs of a state and an arc that a worker remembers.
REMEMBERED, PIECE, BATCH, LONG, TOGETHER, OPEN = 250_000, 1 << 20, 2 << 20, 48, 8192, 1 << 18
#: Kinds of characters by the pattern: letters, numbers, others, white space; 0 is between texts.
LETTER, NUMBER, OTHER, WHITE = 1, 2, 3, 4
NEVER = np.int64(1 << 40)


def byte_names() -> dict[str, int]:
    """The printable characters by which vocabulary files name bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in plain}
    names.update({chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in set(plain))})
    return names


def disjoint(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans (first, last, rank), by last, that cover the same places, each place under its smallest rank."""
    spans = sorted(spans)
    if all(a[1] < b[0] for a, b in zip(spans, spans[1:])):
        return spans
    edges = sorted({p for first, last, _ in spans for p in (first, last + 1)})
    out = []
    for lo, hi in zip(edges, edges[1:]):
        over = [rank for first, last, rank in spans if first <= lo and hi - 1 <= last]
        if over:
            out.append((lo, hi - 1, min(over)))
    return out


class Automaton:
    """The compiled table. Arrays by token: `place` (its arc's number), `made` (the merge that makes it), `tail` (its
    right part, whose row its own goes on with), `after` and `bound` (the next row with intervals on that way, and
    the merge before which those count). Arrays by interval, in order of state and last arc: `key` (both in one
    number), `first`, `rank`. The trie of labels: a node's children are at `base` and their byte, where `owner` is
    the node; `token` of a node."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]) -> None:
        name = byte_names()
        self.ids = {bytes(name[c] for c in t): i for t, i in vocabulary.items() if all(c in name for c in t)}
        self.label = {i: b for b, i in self.ids.items()}
        n = self.size = max(vocabulary.values()) + 1
        self.made, self.left, self.tail = np.full(n + 1, NEVER), np.full(n + 1, -1), np.full(n + 1, -1)
        gadgets = []
        for rank, (u, v) in enumerate(merges):
            u, v, w = vocabulary[u], vocabulary[v], vocabulary[u + v]
            gadgets.append((u, v))
            if self.made[w] == NEVER:
                self.made[w], self.left[w], self.tail[w] = rank, u, v
        self.known = np.full(OPEN, -1, dtype=np.int64)
        self._number()
        self._compile(gadgets)
        self._spell()

    def _number(self) -> None:
        """Post-order of the tree of left parts, children in order of their merges: place, and low, the smallest
        place under a token."""
        n = self.size
        self.children: list[list[int]] = [[] for _ in range(n)]
        for w in np.argsort(self.made[:n], kind="stable").tolist():
            if self.left[w] >= 0:
                self.children[self.left[w]].append(w)
        self.place, self.low = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        at = 0
        for root in np.nonzero(self.left[:n] < 0)[0].tolist():
            todo = [(root, False)]
            while todo:
                w, done = todo.pop()
                if done:
                    self.place[w] = at
                    at += 1
                else:
                    self.low[w] = at
                    todo.append((w, True))
                    todo += [(c, False) for c in reversed(self.children[w])]

    def _compile(self, gadgets: list[tuple[int, int]]) -> None:
        rows: dict[int, list[tuple[int, int, int]]] = {}
        made = self.made.tolist()
        for rank, (u, v) in enumerate(gadgets):
            younger = self.children[v]
            k = bisect_left(younger, rank, key=made.__getitem__)
            first = self.low[younger[k]] if k < len(younger) else self.place[v]
            rows.setdefault(u, []).append((int(first), int(self.place[v]), rank))
        self.wide = self.size + 1
        flat = [(u * self.wide + last, first, rank) for u in sorted(rows) for first, last, rank in disjoint(rows[u])]
        flat.append((1 << 62, 1 << 40, 0))
        self.key, self.first, self.rank = (np.array(x, dtype=np.int64) for x in zip(*flat))
        self.key_, self.first_, self.rank_ = self.key.tolist(), self.first.tolist(), self.rank.tolist()
        self.place_, self.made_, self.tail_ = self.place.tolist(), made, self.tail.tolist()
        self.has = np.zeros(self.size + 1, dtype=bool)
        self.has[list(rows)] = True
        self.after, self.bound = self.tail.copy(), self.made.copy()
        for w in np.argsort(self.made[: self.size], kind="stable").tolist():  # right parts first
            tail = self.tail_[w]
            if tail >= 0 and not self.has[tail]:
                self.after[w], self.bound[w] = self.after[tail], self.bound[tail]

    def _spell(self) -> None:
        """The trie of the labels of arcs that are there, its nodes' rows of children laid into one array."""
        alive = self.alive()
        children: list[dict[int, int]] = [{}]
        token = [-1]
        for label, i in self.ids.items():
            if not label or not alive[i]:
                continue
            node = 0
            for byte in label:
                new = children[node].setdefault(byte, len(token))
                if new == len(token):
                    token.append(-1)
                    children.append({})
                node = new
            token[node] = i
        # rows of more children first; each at the first of its own pseudo-random places that are all free, which
        # is soon found while the array stays a third full
        size = 1 << (3 * len(token)).bit_length()
        used = bytearray(size + 256)
        self.base = np.zeros(len(token), dtype=np.int64)
        for node in sorted(range(len(token)), key=lambda k: -len(children[k])):
            row, at = list(children[node]), node
            while any(used[at * 2654435761 % size + b] for b in row):
                at += len(token)
            self.base[node] = at * 2654435761 % size
            for b in row:
                used[self.base[node] + b] = 1
        self.owner, self.to = np.full(len(used), -1), np.full(len(used), -1)
        for node, row in enumerate(children):
            for byte, new in row.items():
                self.owner[self.base[node] + byte], self.to[self.base[node] + byte] = node, new
        self.token = np.array(token, dtype=np.int64)
        self.lengths = np.zeros(self.size, dtype=np.int64)
        for label, i in self.ids.items():
            self.lengths[i] = len(label)
        self.longest = max((len(b) for b, i in self.ids.items() if alive[i]), default=0)

    def alive(self) -> np.ndarray:
        """Tokens whose gadget found an arc to build on: bytes, and merges of such whose pair was open then."""
        out = np.ones(self.size + 1, dtype=bool)
        for w in np.argsort(self.made[: self.size], kind="stable").tolist():
            if self.made_[w] < NEVER:
                u, v = int(self.left[w]), self.tail_[w]
                out[w] = out[u] and out[v] and self.open(u, v, self.made_[w])
        return out

    def open(self, state: int, arc: int, before: int = int(NEVER)) -> bool:
        """Whether a state has an arc, by the gadgets of merges before a number; the start has all."""
        at = self.place_[arc]
        while state >= 0:
            key = state * self.wide + at
            k = bisect_left(self.key_, key)
            if self.key_[k] - key < self.wide - at and self.first_[k] <= at and self.rank_[k] < before:
                return False
            before, state = min(before, self.made_[state]), self.tail_[state]
        return True

    def opens(self, state: np.ndarray, arc: np.ndarray) -> np.ndarray:
        """open() of many states and arcs; state `size` is the start. Pairs that come again are remembered, each at a place of
        its own that another pair may take."""
        pair = state * self.wide + arc
        place = (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % len(self.known)
        held = self.known[place]
        ok, new = (held & 1).astype(bool), np.flatnonzero(held >> 1 != pair)
        if len(new):
            ok[new] = found = self._opens(state[new], arc[new])
            self.known[place[new]] = pair[new] << 1 | found
        return ok

    def _opens(self, state: np.ndarray, arc: np.ndarray) -> np.ndarray:
        ok = np.ones(len(state), dtype=bool)
        x, before, at = state, np.full(len(state), NEVER), self.place[arc]
        skip = ~self.has[x]
        before, x = np.where(skip, self.bound[x], before), np.where(skip, self.after[x], x)
        row = np.nonzero(x >= 0)[0]
        x, before, at = x[row], before[row], at[row]
        while len(row):
            key = x * self.wide + at
            k = np.searchsorted(self.key, key)
            hit = (self.key[k] - key < self.wide - at) & (self.first[k] <= at) & (self.rank[k] < before)
            ok[row[hit]] = False
            next_ = self.after[x]
            go = ~hit & (next_ >= 0)
            row, at, before, x = row[go], at[go], self.bound[x[go]], next_[go]
        return ok

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Where the trie's nodes lead by a byte, -1 for nowhere."""
        k = self.base[node] + byte
        return np.where(self.owner[k] == node, self.to[k], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each word, and the ids of all, word after word."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        far = int((sizes > LONG).sum())
        found = [([k], *self._alone(words[k])) for k in order[:far].tolist()]
        for at in range(far, len(order), TOGETHER):
            some = order[at : at + TOGETHER]
            found.append((some, *self._together([words[k] for k in some.tolist()], sizes[some])))
        counts = np.zeros(len(words), dtype=np.int64)
        for some, n, _ in found:
            counts[some] = n
        starts = np.cumsum(counts) - counts
        flat = np.zeros(int(counts.sum()), dtype=np.int32)
        for some, n, ids in found:
            flat[ragged(starts[some], n)] = ids
        return counts, flat

    def _together(self, words: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words, the longest first, by steps that all of them take together."""
        width = int(sizes[0]) if len(sizes) else 0
        text = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width).astype(np.int64)
        # the token that ends at each place of each word
        state = np.full((len(words), width + 1), -1, dtype=np.int64)
        state[:, 0] = self.size
        for at in range(width):
            row = np.nonzero(sizes > at)[0]
            node, from_ = np.zeros(len(row), np.int64), state[row, at]
            # a place that no walk reaches begins nothing
            row, node, from_ = row[from_ >= 0], node[from_ >= 0], from_[from_ >= 0]
            for end in range(at + 1, min(width, at + self.longest) + 1):
                node = self.step(node, text[row, end - 1])
                go = (node >= 0) & (sizes[row] >= end)
                row, node, from_ = row[go], node[go], from_[go]
                if not len(row):
                    break
                token = self.token[node]
                some = np.nonzero(token >= 0)[0]
                some = some[self.opens(from_[some], token[some])]
                state[row[some], end] = token[some]
        # back from the ends along the one walk that reaches them
        at, rows, held = sizes.copy(), np.arange(len(words)), []
        while len(rows := rows[at[rows] > 0]):
            token = state[rows, at[rows]]
            if (token < 0).any():
                raise ValueError("a byte without a token")
            held.append((rows, token))
            at[rows] -= self.lengths[token]
        if not held:
            return np.zeros(len(words), np.int64), np.zeros(0, np.int64)
        row, token = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        return np.bincount(row, minlength=len(words)), token[::-1][np.argsort(row[::-1], kind="stable")]

    def _alone(self, word: bytes) -> tuple[np.ndarray, np.ndarray]:
        """A long word: its arcs are read from the trie piece by piece, then it walks as the others do."""
        n, known = len(word), {}
        state = np.full(n + 1, -1, dtype=np.int64)
        state[0] = -2
        for begin in range(0, n, 1 << 16):
            text = np.frombuffer(word, np.uint8, min((1 << 16) + self.longest, n - begin), begin).astype(np.int64)
            row = np.arange(min(1 << 16, n - begin))
            node, found = np.zeros(len(row), np.int64), []
            for k in range(self.longest):
                inside = row + k < len(text)
                row, node = row[inside], node[inside]
                node = self.step(node, text[row + k])
                row, node = row[node >= 0], node[node >= 0]
                if not len(row):
                    break
                some = self.token[node] >= 0
                found.append((row[some] + begin, self.token[node[some]], np.full(int(some.sum()), k + 1)))
            row, token, size = (np.concatenate([f[k] for f in found]) for k in (0, 1, 2))
            order = np.lexsort((size, row))
            for at, t, k in zip(row[order].tolist(), token[order].tolist(), size[order].tolist()):
                from_ = int(state[at])
                if from_ == -1:
                    continue
                ok = known.get((from_, t))
                if ok is None:
                    if len(known) > 1 << 16:
                        known.clear()
                    ok = known[from_, t] = self.open(from_, t)
                if ok:
                    state[at + k] = t
        out, at = [], n
        while at:
            token = int(state[at])
            if token < 0:
                raise ValueError("a byte without a token")
            out.append(token)
            at -= int(self.lengths[token])
        return np.array([len(out)]), np.array(out[::-1], dtype=np.int64)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), then the same of starts[1], and so on."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(np.asarray(starts) - (ends - counts), counts)


class Words(dict):
    """Numbers of words, new ones as they come; `new` lists those."""

    def __init__(self) -> None:
        self.new: list = []

    def __missing__(self, word) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of each character."""
    every = "".join(map(chr, range(0x110000)))
    out = np.full(len(every), OTHER, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        for found in regex.finditer(pattern, every):
            out[found.start() : found.end()] = kind
    return out


def split(char: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pattern's matches begin and end (before) in characters of given kinds; none goes across one of kind 0.

    Matches are runs of one kind, but for two rules. White space that something follows gives its last character away: to what
    follows, if it is a space, else it is a match of its own. An apostrophe alone, with no space before it, takes the letters of
    a contraction from the run that follows."""
    begin, end = words.runs(kind)
    if not len(begin):
        return begin, end
    own = kind[begin]
    next_ = np.append(begin[1:] == end[:-1], False)
    white = np.flatnonzero((own == WHITE) & next_)
    last = end[white] - 1
    space = char[last] == 32
    end[white] -= 1
    begin[white[space] + 1] -= 1
    # "'" that is a run of its own, and the first letters of what follows it
    mark = np.flatnonzero((own == OTHER) & (end - begin == 1) & (char[begin] == 39) & next_)
    mark = mark[own[mark + 1] == LETTER]
    one = char[begin[mark + 1]]
    two = char[np.minimum(begin[mark + 1] + 1, len(char) - 1)]
    few = np.isin(one, [ord(c) for c in "stmd"])
    more = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
    takes = few + 2 * (more & (end[mark + 1] - begin[mark + 1] > 1))
    end[mark] += takes
    begin[mark + 1] += takes
    alone = last[~space]
    begin, end = np.concatenate([begin, alone]), np.concatenate([end, alone + 1])
    real = end > begin
    begin, end = begin[real], end[real]
    order = np.argsort(begin, kind="stable") if len(alone) else slice(None)
    return begin[order], end[order]


def distinct(data: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of stretches of bytes, in order and none empty: one of each different one, and for each stretch which of those it equals.
    Found by hash, then compared byte by byte; one that only has another's hash stands for itself."""
    _, first, which = np.unique(words.xxh64s(data, start, size, 0), return_index=True, return_inverse=True)
    to = first[which]
    same = size == size[to]
    eight = np.ascontiguousarray(np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,)))
    short = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (8 - np.minimum(size, 8)).astype(np.uint64))
    same &= (eight[start] ^ eight[start[to]]) & short == 0
    far = np.flatnonzero(same & (size > 8) & (to != np.arange(len(to))))
    at = 8
    while len(far):
        # the last eight bytes of each go over what was compared
        k = np.minimum(at, size[far] - 8)
        differs = eight[start[far] + k] != eight[start[to[far]] + k]
        same[far[differs]] = False
        far = far[~differs & (size[far] > at + 8)]
        at += 8
    if same.all():
        return first, which
    odd = np.flatnonzero(~same)
    which[odd] = len(first) + np.arange(len(odd))
    return np.concatenate([first, odd]), which


class Tokenizer:
    """A byte-level BPE vocabulary file with its special tokens, encoded by the automaton."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check(spec, path)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        label = self.automaton.label | {i: t.encode() for t, i in self.special.items()}
        top = max(label) + 1
        self.names = [str(i) for i in range(top)]
        self.labels = [label.get(i, b"") for i in range(top)]
        ordered = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, ordered)) + ")") if ordered else None
        self.gap = re.compile(f"(?<=[^{SPACE}])[{SPACE}]")
        # words that are remembered: numbers, and by number how often they came, where their ids are, how many
        self.words = Words()
        self.uses, self.starts, self.counts, self.ids = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int32))

    def pieces(self, text: str) -> Iterator[str]:
        """A text in pieces of about PIECE characters, cut where white space begins and around special tokens."""
        parts = self.cut.split(text) if self.cut and any(t in text for t in self.special) else [text]
        for part in parts:
            at = 0
            while len(part) - at > PIECE:
                found = self.gap.search(part, at + PIECE)
                end = found.start() if found else len(part)
                yield part[at:end]
                at = end
            yield part[at:] if at else part

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """ids of each text. Pieces of texts of PIECE characters in all are split, and their words looked up, at a time."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, str]] = []
        size = 0
        for k, text in enumerate(texts):
            for piece in self.pieces(text):
                held.append((k, piece))
                size += len(piece)
                if size >= PIECE:
                    self._look_up(held, out)
                    size = 0
        self._look_up(held, out)
        return [parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.int32), *parts]) for parts in out]

    def numbers(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of pieces, piece after piece, and where each piece's begin (and the last one's end)."""
        text = "\0".join(pieces)
        data = text.encode()
        lengths = np.array([len(p) for p in pieces])
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        if len(data) == len(text):
            char = np.frombuffer(data, np.uint8)
        else:
            char = np.frombuffer(text.encode("utf-32-le"), "<u4")
        kind = kinds()[char]
        kind[starts[1:-1] - 1] = 0
        begin, end = split(char, kind)
        bounds = np.searchsorted(begin, starts)
        if len(data) != len(text):
            # where characters begin in bytes
            place = np.zeros(len(char) + 1, dtype=np.int64)
            np.cumsum(1 + (char >= 0x80).astype(np.int8) + (char >= 0x800) + (char >= 0x10000), out=place[1:])
            begin, end = place[begin], place[end]
        if not len(begin):
            return np.zeros(0, np.int64), bounds
        one, which = distinct(data, begin, end - begin)
        found = map(self.words.__getitem__, (data[a:b] for a, b in zip(begin[one].tolist(), end[one].tolist())))
        return np.fromiter(found, np.int64, len(one))[which], bounds

    def _look_up(self, held: list[tuple[int, str]], out: list[list[np.ndarray]]) -> None:
        """Encodes the words that are new, then all pieces that are held: words, or special tokens."""
        numbers, bounds = self.numbers([piece for _, piece in held if piece not in self.special] or [""])
        new = self.words.new
        if new:
            counts, ids = self.automaton.encode(new)
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
            self.counts, self.ids = np.concatenate([self.counts, counts]), np.concatenate([self.ids, ids])
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
            new.clear()
        self.uses += np.bincount(numbers, minlength=len(self.uses))
        counts = self.counts[numbers]
        flat = self.ids[ragged(self.starts[numbers], counts)]
        ends = iter(np.concatenate([[0], np.cumsum(counts)])[bounds[1:]].tolist())
        at = 0
        for k, piece in held:
            if piece in self.special:
                out[k].append(np.array([self.special[piece]], dtype=np.int32))
            else:
                end = next(ends)
                out[k].append(flat[at:end])
                at = end
        held.clear()
        if len(self.words) > REMEMBERED:
            self._forget()

    def _forget(self) -> None:
        """Keeps the words that came most, half of REMEMBERED at the most, and none that is long; counts start again."""
        order = np.argsort(-self.uses, kind="stable")[: REMEMBERED // 2]
        keep = np.zeros(len(self.uses), dtype=bool)
        keep[order] = (self.uses[order] > 1) & (self.counts[order] <= LONG)
        words, self.words = self.words, Words()
        self.words.update(zip((w for w, k in zip(words, keep.tolist()) if k), range(int(keep.sum()))))
        self.ids = self.ids[ragged(self.starts[keep], self.counts[keep])]
        self.counts = self.counts[keep]
        self.starts, self.uses = np.cumsum(self.counts) - self.counts, np.zeros(len(self.counts), np.int64)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids))


def check(spec: dict, path: str) -> None:
    """Refuses a vocabulary file whose rules are not those that are compiled here."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    right = (
        model.get("type", "BPE") == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and spec.get("normalizer") is None
        and before.get("type") == "ByteLevel"
        and not before.get("add_prefix_space")
        and before.get("use_regex", True)
        and not any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
    )
    if not right:
        raise ValueError(f"{path} is no plain byte-level BPE: its text rules are not those of this automaton")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """One for each worker process."""
    return Tokenizer(path)


def listed(ids: list[np.ndarray]) -> pa.ListArray:
    """An Arrow array of lists of ids."""
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int32), *ids]))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids, one row per row of docs. The path is of a vocabulary file that every executor has."""
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in slices(batches, BATCH):
            yield record(schema, batch.column("doc_id").cast(pa.int64()), listed(t.encode_all([x or "" for x in batch.column("text").to_pylist()])))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and text from doc_id and ids; bytes that aren't UTF-8 become U+FFFD, null ids an empty text."""
    prepare(ids.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in slices(batches, BATCH):
            yield record(schema, batch.column("doc_id"), [t.decode(x or []).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()])

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
            counts, ids_, texts_ = [], [], []
            for found in t.encode_all([x or "" for x in batch.column("text").to_pylist()]):
                ids = found.tolist()
                counts.append(len(ids))
                ids_.append(sha(",".join(map(name, ids)).encode()))
                texts_.append(sha(t.decode(ids).decode("utf-8", "replace").encode()))
            yield record(schema, batch.column("doc_id").cast(pa.int64()), counts, ids_, texts_)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
