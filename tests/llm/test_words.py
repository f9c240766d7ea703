"""Many words at once against one at a time: hashes, splits, different words, bits, and that no library call is made for each."""

import random
import zlib

import numpy as np
import pytest
import regex
import xxhash

from palisade.llm import bpe, quality, simhash, words
from palisade.llm.queries import vocabulary


def test_hashes_are_the_libraries(monkeypatch):
    rng = random.Random(1)
    data = rng.randbytes(30_000)
    size = np.array([rng.choice((0, 3, 4, 8, 31, 32, 33, 64, 65, 127, 700, rng.randrange(90))) for _ in range(4000)])
    start = np.sort(np.array([rng.randrange(29_000) for _ in size]))
    parts = [data[s : s + n] for s, n in zip(start.tolist(), size.tolist())]
    monkeypatch.setattr(words, "SOME", 1500)
    for seed in (0, 42):
        assert words.xxh64s(data, start, size, seed).tolist() == [xxhash.xxh64_intdigest(p, seed) for p in parts]
    assert words.crc32s(data, start, size).tolist() == [zlib.crc32(p) for p in parts]
    none = np.zeros(0, np.int64)
    assert not len(words.xxh64s(b"", none, none, 1)) and not len(words.crc32s(b"", none, none))


def test_majorities():
    x = np.random.default_rng(2).integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    bounds = np.array([0, 0, 1, 3, 258, 513, 513, 3000, 3000])
    want = [sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in x[i:j].tolist()) > j - i) for i, j in zip(bounds[:-1], bounds[1:])]
    assert words.majorities(x, bounds).tolist() == want
    assert words.majorities(x[:0], np.zeros(3, np.int64)).tolist() == [0, 0]


def test_shingles_one_text_at_a_time():
    held = [b"", b" \n ", b"One", b"one  TWO", b"a b a b a b a", "ä Ö é b".encode(), b"x " * 700]
    for size in (1, 2, 5):
        got, bounds = simhash.sets_of(held, size)
        for text, a, b in zip(held, bounds, bounds[1:]):
            w = text.lower().split()
            assert got[a:b].tolist() == sorted({xxhash.xxh64_intdigest(b" ".join(w[k : k + size]), 42) for k in range(max(len(w) - size + 1, 1))} if w else [])


def test_tokens_are_those_of_the_rule():
    held = [b"", b" \n", b"A AB aB ab AB1", "\u00c4B \u00e4".encode(), b"1 \x1c2!\x00!\x0b!", b"x" * 700, bytes(range(256))]
    got, bounds = quality.tokens(held)
    for text, a, b in zip(held, bounds, bounds[1:]):
        assert got[a:b].tolist() == [quality.bucket(t) for t in quality.TOKEN.findall(text)]


def test_split_is_the_pattern():
    rng, pattern = random.Random(3), regex.compile(bpe.PATTERN)
    for _ in range(3000):
        pieces = ["".join(rng.choices("ab'strevmld  \n\t\x1c\x85 　é1²'’!?\0字Ⅷ😀", k=rng.randrange(14))) for _ in range(rng.randrange(1, 5))]
        text = "\0".join(pieces)
        char = np.frombuffer(text.encode("utf-32-le"), "<u4")
        kind = bpe.kinds()[char]
        kind[np.cumsum([len(p) + 1 for p in pieces])[:-1] - 1] = 0
        assert [text[a:b] for a, b in zip(*bpe.split(char, kind))] == [w for p in pieces for w in pattern.findall(p)]


@pytest.mark.parametrize("clash", [False, True])
def test_different_words_are_told_apart_whatever_their_hashes(monkeypatch, clash):
    rng = random.Random(5)
    held = [b"a" * rng.randrange(1, 30) + rng.choice((b"", b"\0", b"b", b"bc" * 9)) for _ in range(500)]
    size = np.array([len(w) for w in held])
    if clash:
        monkeypatch.setattr(words, "xxh64s", lambda data, start, size, seed: size.astype(np.uint64) % np.uint64(7))
    one, which = bpe.distinct(b"".join(held), np.cumsum(size) - size, size)
    assert [held[one[k]] for k in which] == held
    assert clash or len(one) == len(set(held))


def test_no_call_for_each_word(monkeypatch):
    """Calls by word were most of the pipeline's time."""
    text = " ".join(f"{w}{k % 97}" for k, w in enumerate(["word", "another", "thing", "it's"] * 5000))
    calls, real = [], xxhash.xxh64_intdigest
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda *a: calls.append(1) or real(*a))
    monkeypatch.setattr(zlib, "crc32", lambda x, real=zlib.crc32: calls.append(1) or real(x))
    t = bpe.Tokenizer(vocabulary("byte_bpe_50k.json"))
    looked, real_look = [], bpe.Words.__getitem__
    monkeypatch.setattr(bpe.Words, "__getitem__", lambda self, w: looked.append(1) or real_look(self, w), raising=False)
    simhash.sketches_of([text.encode()])
    quality.tokens([text.encode()])
    assert t.decode(t.encode(text)) == text.encode()
    assert len(calls) < 500 and len(looked) < 1000
