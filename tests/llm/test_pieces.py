"""SentencePiece encoding and decoding against the library, id for id."""

import hashlib
import random

import pytest
import sentencepiece

from palisade.llm import pieces
from palisade.llm.queries import vocabulary

PATH = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    return pieces.Tokenizer(PATH)


def texts():
    rng = random.Random(11)
    kinds = ["abcdefghij ", "     a", "the quick brown fox ", "▁ a▁", "éüß日本語梦 \n\t", "\x00 😀a ", "0123456789.,;:!?()<>/\\ ", "aAbB", " "]
    for _ in range(1500):
        kind = rng.choice(kinds)
        yield "".join(rng.choice(kind) for _ in range(rng.choice((0, 1, 2, 3, 5, 10, 40, 200))))
    for k in range(0, 120):
        yield from (" " * k, " " * k + "x", "a" + " " * k + "the", "a" * k)
    yield from ("<s> </s> <unk> <0x41>", "\ufffd\ufeff\u3000x", "a\u0301")


def test_ids_and_texts(library, own):
    some = list(texts())
    want = library.encode(some)
    got = [x.tolist() for x in own.encode_all(some)]
    assert got == want
    assert [own.decode(x) for x in got] == [library.decode(x) for x in want]


def test_decoding_of_any_ids(library, own):
    rng = random.Random(2)
    for _ in range(1500):
        ids = [rng.randrange(own.automaton.size if rng.random() < 0.5 else 262) for _ in range(rng.randrange(10))]
        assert own.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("text", ["a" * 100_000, " " * 100_000 + "b", "".join(random.Random(1).choice("etaoin") for _ in range(60_000)), "日本" * 40_000])
def test_long_words(library, own, text):
    assert own.encode(text) == library.encode(text)


def test_words_are_forgotten(library, own, monkeypatch):
    from palisade.llm import bpe

    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    monkeypatch.setattr(bpe, "PIECE", 300)
    some = [" ".join(f"word{k * j % 97}" for k in range(200)) for j in range(20)]
    assert [x.tolist() for x in own.encode_all(some)] == library.encode(some)


def merged(symbols, scores):
    """The highest score, then the leftmost, until nothing can be merged."""
    symbols = list(symbols)
    while True:
        best = max(((scores[a + b], -k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in scores), default=None)
        if best is None:
            return symbols
        k = -best[1]
        symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]


def test_vocabularies_of_any_order():
    """Equal scores and pieces that come before their parts: rounds and heap as one merge at a time."""
    rng = random.Random(8)
    for _ in range(60):
        names = {c: 0.0 for c in "▁abc"}
        for _ in range(rng.randrange(3, 14)):
            names["".join(rng.choice("abc") for _ in range(rng.choice((2, 2, 3, 4))))] = float(rng.randrange(-5, 0))
        names |= {"▁" * k: -9.0 for k in rng.sample((2, 3, 4, 5), rng.randrange(3))} | ({"▁a": -2.0} if rng.random() < 0.5 else {})
        vocabulary = [(p, s, pieces.NORMAL) for p, s in names.items()] + [(f"<0x{b:02X}>", 0.0, pieces.BYTE) for b in range(256)]
        compiled = pieces.Merges(vocabulary)
        words = ["▁" * rng.choice((1, 1, 2, 7, 30)) + "".join(rng.choice("abc") for _ in range(rng.randrange(30))) for _ in range(40)]
        want = [merged(w, names) for w in words]
        counts, ids = compiled.encode([w.encode() for w in words])
        assert counts.tolist() == list(map(len, want))
        assert ids.tolist() == [list(names).index(p) for w in want for p in w]
        import numpy as np

        alone = [compiled.alone(np.array([compiled.number[c] for c in w])) for w in words]
        assert [[compiled.names[s] for s in a] for a in alone] == want


def test_report(spark, library):
    rows = [(1, "Hello  world"), (1, "Hello  world"), (2, None), (3, ""), (None, "x\n"), (4, "word " * 300_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, ids int, n_tokens int").repartition(3)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode(t or "")
        want.append((str(i), len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode(ids).encode())))
    assert sorted((str(r[0]), *r[1:]) for r in pieces.report(df, PATH).collect()) == sorted(want)
    back = pieces.decoded(pieces.encoded(df, PATH), PATH).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t in rows)
    assert pieces.report(df.limit(0), PATH).count() == 0


def test_refuses_other_rules(tmp_path):
    data = open(PATH, "rb").read()
    spec = sentencepiece.SentencePieceProcessor(model_file=PATH).serialized_model_proto()
    assert spec == data
    (tmp_path / "m").write_bytes(data + b"\x12\x02\x18\x01")  # a later trainer spec: another kind of model
    with pytest.raises(ValueError):
        pieces.read(str(tmp_path / "m"))
