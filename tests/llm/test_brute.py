"""Operators against brute force, the tokenizers library, exact round trips and held-out accuracy."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from palisade.llm import bpe, decontaminate, langid, quality, queries, simhash, suffix, tokenstore, topk, toxicity
from palisade.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    t = pq.read_table(f"{SF}/documents.parquet")
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))


def frame(spark, rows):
    return spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)


def removed(rows, length):
    first = {}
    texts = {d: (t or "").encode() for d, t in sorted(rows.items())}
    for d, t in texts.items():
        for i in range(len(t) - length + 1):
            first.setdefault(t[i : i + length], (d, i))
    out = {}
    for d, t in texts.items():
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] != (d, i):
                gone[i : i + length] = b"\1" * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest())
    return out


def as_report(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_suffix_on_documents(spark, rows):
    assert as_report(suffix.report(frame(spark, rows))) == removed(rows, 100)


@pytest.mark.parametrize("small", [False, True])
def test_suffix_on_hard_texts(spark, monkeypatch, small):
    """Overlaps, periods, shared passages; with tiny shards, pieces and hot bounds, so that every path runs."""
    rng = random.Random(5)
    line = "".join(rng.choice("abc ") for _ in range(140))
    other = "".join(rng.choice("abcdefgh ") for _ in range(900))
    texts = ["a" * 450, "ab" * 300, "a" * 333, "", line, other[:500], "éü" * 130]
    for k in range(60):
        noise = lambda n: "".join(rng.choice("xyzuvw ") for _ in range(n))
        texts.append(noise(rng.randint(0, 90)) + line + noise(rng.randint(0, 200)) + other[k * 7 : k * 7 + 260])
    if small:
        for name, value in (("SHARD", 3000), ("PIECE", 700), ("HELD", 50), ("HOT", 4), ("SAMPLE", 1)):
            monkeypatch.setattr(suffix, name, value)
    rows = dict(enumerate(texts))
    assert as_report(suffix.report(frame(spark, rows))) == removed(rows, 100)


def test_suffix_merges_shards(spark, monkeypatch):
    """One anchor's runs over many shards, none of them split as hot: the binary search merge does it."""
    rng = random.Random(9)
    core = "".join(rng.choice("abcdefgh") for _ in range(60))
    rows = {k: "".join(rng.choice("xy") for _ in range(k % 5)) + "q" * 30 + core + "r" * 25 + "".join(rng.choice("xy") for _ in range(40)) for k in range(300)}
    monkeypatch.setattr(suffix, "SHARD", 2000)
    assert as_report(suffix.report(frame(spark, rows))) == removed(rows, 100)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for n, k in ((1, 2), (50, 1), (700, 2), (3000, 4), (1200, 250)):
        text = rng.integers(0, k, n).astype(np.uint8)
        raw = text.tobytes()
        order = suffix.suffix_array(text)
        assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])
        got = suffix.common_prefixes(text, order, 20, lane=64)
        for r in range(1, n):
            a, b = raw[order[r - 1] :], raw[order[r] :]
            m = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert got[r] == min(m, 20)


def test_simhash(spark, rows):
    rng = random.Random(3)
    for k in range(80):  # near copies in chains
        base = (rows[k % 9] or "").split() or ["a"]
        for _ in range(rng.randint(0, 3)):
            base[rng.randrange(len(base))] = "zz"
        rows = rows | {1000 + k: " ".join(base)}
    docs = frame(spark, rows)
    fp = {d: simhash.fingerprint_of((t or "").encode()) for d, t in rows.items()}
    native = docs.withColumn("w", F.filter(F.split(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    some = native.where(F.size("w") >= 3).select("doc_id", F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.xxhash64(F.array_join(F.slice("w", i, 3), " "))).alias("h"))
    for r in some.limit(60).collect():
        h = np.array(r.h, dtype=np.int64).view(np.uint64)
        assert fp[r.doc_id] == sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))
    root = {d: d for d in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(rows)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fp[a] ^ fp[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {d: (f"{fp[d]:016x}", find(d)) for d in rows}
    for most in (4096, 3):
        got = {r.doc_id: (f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in simhash.classes(docs, most=most).collect()}
        assert got == want


def test_bk_trees_find_all_links():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(9))]))
    trees = simhash.Forest(fp, np.zeros(len(fp), dtype=np.int64))
    found = {(int(a), int(b)) for q, m in trees.links(np.arange(len(fp)), np.zeros(len(fp), dtype=np.int64), 3) for a, b in zip(q, m)}
    assert found == {(i, j) for i in range(len(fp)) for j in range(len(fp)) if (int(fp[i]) ^ int(fp[j])).bit_count() <= 3}


def test_decontaminate_blocks_and_spans(spark, rows):
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    bench = spark.createDataFrame([(r["item_id"], r["text"]) for r in items] + [(900, "one two"), (901, "Zwei")], "item_id long, text string")
    rows = rows | {5000: "so one two and ZWEI words " + items[0]["text"], 5001: "one, two!"}
    docs = frame(spark, rows)
    whole = {r.doc_id: r for r in decontaminate.report(docs, bench).collect()}
    assert whole[5001].n_hit == 2 and whole[5000].n_items == 3
    cut = {r.doc_id: r for r in decontaminate.report(docs, bench, most_words=100).collect()}
    assert whole == cut
    spans = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, mode="span").collect()}
    assert spans[5001] == "!" and len(spans) == len(rows)
    kept = {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()}
    assert kept == {d for d, r in whole.items() if not r.contaminated}
    assert decontaminate.items_digest(["900"]) == whole[5001].items_sha256


def test_bpe_is_the_library(spark, rows):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(2)
    extra = ["<|endoftext|>a <|endoftext|>", "a" * 999, "--" * 300, "\x1c a  \u3000b\xa0 c", "I'll they've 'S"]
    extra += ["".join(rng.choice("abthe ingors'A0\n.-=é日🙂") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    rows = rows | {7000 + k: t for k, t in enumerate(extra)}
    docs = frame(spark, rows)
    got = {r.doc_id: r.ids for r in bpe.encoded(docs, path).collect()}
    for d, t in rows.items():
        assert got[d] == library.encode(t or "", add_special_tokens=False).ids
    back = {r.doc_id: r.text for r in bpe.decoded(bpe.encoded(docs, path), path).collect()}
    assert back == {d: t or "" for d, t in rows.items()}
    odd = spark.createDataFrame([(1, [447, 220]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decoded(odd, path).collect()} == {1: library.decode([447, 220], skip_special_tokens=False), 2: ""}


def test_token_store(spark, rows, tmp_path):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = rows | {8000: "<|ENDOFTEXT|> <|endoftext|> don't 12 É é \x1c", 8001: None}
    docs = frame(spark, rows)
    shards = tokenstore.write(docs, f"file://{tmp_path}/ids", path)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenstore.read(spark, shards, docs).collect()}
    start = 0
    for d, t in sorted(rows.items()):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        assert got[d] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
        if d % 50 == 0:
            assert [x.tolist() for x in tokenstore.lookup(shards, d)] == [ids.tolist()]
    assert tokenstore.lookup(shards, 123456789) == []
    absent = spark.createDataFrame([(123456789,)], "doc_id long")
    assert tokenstore.read(spark, shards, absent).count() == 0


def test_token_store_lookups_read_little(spark, tmp_path):
    """What a lookup reads doesn't grow with the shard, and repeated keys go on in the next shard."""
    from pyarrow.fs import LocalFileSystem

    read = [0]

    class Counted:
        def __init__(self, file):
            self.file, self.closed = file, False

        def read(self, size=-1):
            out = self.file.read(size)
            read[0] += len(out)
            return out

        def __getattr__(self, name):
            return getattr(self.file, name)

    class Local:
        def open_input_file(self, path):
            return Counted(LocalFileSystem().open_input_file(path))

    sizes = []
    for n in (200, 20_000):
        docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
        shards = tokenstore.write(docs, f"file://{tmp_path}/{n}", vocabulary("word_bpe_49k.json"), shards=1)
        local = [s | {"path": s["path"].removeprefix("file://")} for s in shards]
        read[0] = 0
        for key in range(0, n, n // 50):
            assert len(tokenstore.lookup(local, key, Local())) == 1
        sizes.append(read[0] / 50)
    assert max(sizes) < 1000
    twice = spark.range(900).select((F.col("id") % 3).alias("doc_id"), F.lit("one two").alias("text"))
    shards = tokenstore.write(twice, f"file://{tmp_path}/twice", vocabulary("word_bpe_49k.json"), shards=7)
    assert len(shards) > 3 and [len(tokenstore.lookup(shards, k)) for k in range(-1, 4)] == [0, 300, 300, 300, 0]
    got = tokenstore.read(spark, shards, twice).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(k % 3 for k in range(900)) and [r.start for r in got] == list(range(0, 2700, 3))


def test_token_store_of_another_vocabulary(spark, tmp_path):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["Hello World, this is text", "  two  spaces\n", ""]
    shards = tokenstore.write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), f"file://{tmp_path}/b", path)
    assert [tokenstore.lookup(shards, k)[0].tolist() for k in range(3)] == [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_perfect_hash():
    keys = np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 20_000)
    table = tokenstore.PerfectHash.build(np.unique(keys))
    assert sorted(table.number(np.unique(keys)).tolist()) == list(range(len(np.unique(keys))))


def test_topk_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (700, 16)), np.repeat(rng.normal(0, 0.1, (5, 16)), 40, axis=0)])
    v = spark.createDataFrame([(k, [float(c) for c in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    n = np.floor(x * 1024).astype(np.int64)
    want = {}
    for q in range(0, len(x), 100):
        s = n @ n[q]
        best = [j for j in np.lexsort((np.arange(len(x)), -s)) if j != q][:10]
        want[q] = [(j, s[j]) for j in best]
    for block, shard in ((8 << 20, 65_536), (60, 100)):
        monkeypatch.setattr(topk, "BLOCK", block)
        monkeypatch.setattr(topk, "SHARD", shard)
        got = {}
        for r in topk.report(v).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert got == want


def test_topk_of_any_magnitude(spark):
    rng = np.random.default_rng(1)
    rows = [[400000.0, 1.0], [1.0, 2.0], [300000.0, 0.5], [-(2.0**31), 3.0], [2.0**40, -(2.0**40)], [2.0**40, -(2.0**40) + 1], [1e300, -1e300]]
    rows += [[float(a * 10.0**e), float(b)] for a, b, e in zip(rng.normal(0, 1, 300), rng.normal(0, 1, 300), rng.integers(-2, 9, 300))]
    rows += [[200000.0] * 300, [200000.0] * 299 + [1.0], [-200000.0] * 300]
    v = spark.createDataFrame([(k * 50, r) for k, r in enumerate(rows)], "vec_id long, embedding array<double>")
    n = [[int(np.floor(c * 1024)) if abs(c) < 1e200 else int(c) * 1024 for c in r] for r in rows]
    want = {}
    for q in range(0, len(rows), 2):
        s = [(-sum(a * b for a, b in zip(n[q], n[j])), j) for j in range(len(rows)) if j != q and len(n[j]) == len(n[q])]
        want[q * 50] = [(j * 50, min(max(-x, -(2**63)), 2**63 - 1)) for x, j in sorted(s)[:10]]
    got = {}
    for r in topk.report(v).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {q: x for q, x in want.items() if x}


def accuracy(spark, out, table, column):
    truth = spark.read.parquet(f"/root/testdata/sf0.01/{table}.parquet").select("doc_id", F.col(column).alias("truth"))
    held = out.where("held_out").join(truth, "doc_id").where("truth IS NOT NULL").collect()
    return held


def test_classifiers_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = accuracy(spark, quality.report(docs, quality.fit(docs, labels)), "labels", "quality")
    assert sum(r.predicted == r.truth for r in held) / len(held) > 0.93
    held = accuracy(spark, toxicity.report(docs, toxicity.fit(docs, labels)), "labels", "toxic")
    assert sum(r.predicted == r.truth for r in held) / len(held) > 0.85
    held = accuracy(spark, langid.report(docs, langid.fit(docs)), "documents", "lang")
    assert sum(r.lang_pred == r.truth for r in held) / len(held) > 0.98


def test_labels_and_ids_are_no_inputs(spark):
    """Scores are functions of the text: the same under other ids."""
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    a = {r.doc_id: r.score for r in quality.report(docs, model).collect()}
    moved = docs.withColumn("doc_id", F.col("doc_id") + 1_000_000)
    b = {r.doc_id - 1_000_000: r.score for r in quality.report(moved, model).collect()}
    assert a == b


def test_isotonic_and_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    y = (x[:, 0] + 0.5 * (x[:, 1] > 0) > 0.3).astype(float)
    trees = toxicity.Trees().fit(x[:2000], y[:2000])
    assert ((trees.margin(x[2000:]) > 0) == y[2000:]).mean() > 0.95
    xs, ps = toxicity.isotonic(trees.margin(x), y)
    assert (np.diff(xs) >= 0).all() and (np.diff(ps) >= 0).all()


def test_queries_are_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names[:13]] == [f"op{k}" for k in range(1, 14)] and names[13] == "pipeline"
