"""Each operator and stage on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palisade.llm import bpe, chat, decontaminate, langid, quality, simhash, suffix, tokenstore, topk, toxicity
from palisade.llm.queries import vocabulary

LONG = " ".join(f"word{k} and then some idiot text" for k in range(36000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog near the old river bank today", "en", "a"),
    (1, "the quick brown fox jumps over the lazy dog near the old river bank today", "en", "a"),
    (2, None, None, None),
    (3, "", "de", "b"),
    (None, "ein anderer text", "de", "b"),
    (None, None, None, None),
    (4, LONG, "en", "a"),
    (5, " \n\t ", "de", None),
    (6, "x", None, "b"),
]
KIND = "doc_id long, text string, lang string, source string"
CLASHING = ("rid", "fp", "parts", "more", "label", "h", "_0", "_keep", "score", "component_id", "ids", "count")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, KIND).withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit(7) for c in CLASHING})


@pytest.fixture(scope="module")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (4, 0, 1), (3, 1, None), (None, 1, 1), (99, 0, 0), (6, None, 1), (4, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, "Quick brown fox"), (1, "Quick brown fox"), (None, "lazy dog near"), (2, None), (3, ""), (4, LONG[:400])]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("doc_id", F.lit(3))


def reports(docs, labels, benchmark):
    yield "suffix", suffix.report(docs)
    yield "quality", quality.report(docs, quality.fit(docs, labels))
    yield "decontaminate", decontaminate.report(docs, benchmark)
    yield "langid", langid.report(docs, langid.fit(docs))
    yield "bpe", bpe.report(docs, vocabulary("byte_bpe_50k.json"))
    yield "tokenstore", tokenstore.report(docs, vocabulary("word_bpe_49k.json"))
    yield "simhash", simhash.report(docs)
    yield "toxicity", toxicity.report(docs, toxicity.fit(docs, labels))


def test_one_row_a_row(docs, labels, benchmark):
    for name, out in reports(docs, labels, benchmark):
        rows = out.collect()
        assert len(rows) == len(ROWS), name
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((r[0] is None, r[0] or 0) for r in ROWS), name


def test_empty_tables(none, labels, benchmark):
    for name, out in reports(none, labels.limit(0), benchmark.limit(0)):
        assert out.count() == 0, name


def test_defined_results(docs, labels, benchmark):
    sizes = {(r.doc_id, r.n_bytes): r for r in suffix.report(docs).collect()}
    assert sizes[2, 0].n_removed == 0 and sizes[2, 0].kept_sha256.startswith("e3b0c442")
    hits = {r.doc_id: r for r in decontaminate.report(docs, benchmark).collect()}
    assert hits[2].n_words == 0 and not hits[2].contaminated
    assert hits[1].n_hit == 6 and hits[1].n_items == 1 and hits[1].contaminated
    und = {r.doc_id: r for r in langid.report(docs, langid.fit(docs)).collect()}
    assert und[2].lang_pred == und[3].lang_pred == und[5].lang_pred == "und" and und[6].lang_pred != "und"
    zero = {r.doc_id: r for r in simhash.report(docs).collect() if r.doc_id in (2, 3, 5)}
    assert {r.fingerprint for r in zero.values()} == {"0" * 16} and {r.component_id for r in zero.values()} == {2}
    assert all(0 <= r.score <= 1 for r in quality.report(docs, quality.fit(docs, labels)).collect())
    assert {r.n_tokens for r in tokenstore.report(docs, vocabulary("word_bpe_49k.json")).collect() if r.doc_id == 2} == {1}
    assert {r.n_tokens for r in bpe.report(docs, vocabulary("byte_bpe_50k.json")).collect() if r.doc_id == 2} == {0}


def test_stages(spark, docs, none, labels, benchmark, tmp_path):
    for at, d in (("some", docs), ("none", none)):
        folder = f"{tmp_path}/{at}"
        d.write.parquet(f"{folder}/documents.parquet")
        (labels if at == "some" else labels.limit(0)).write.parquet(f"{folder}/labels.parquet")
        (benchmark if at == "some" else benchmark.limit(0)).write.parquet(f"{folder}/benchmark.parquet")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, d, folder)
            if name != "encode":
                assert out.columns == d.columns, name
                assert [t for _, t in out.dtypes] == [t for _, t in d.dtypes], name
            out.write.parquet(f"{folder}/{name}")
            before, d = d.count(), spark.read.parquet(f"{folder}/{name}")
            assert d.count() <= before
        assert (d.count() > 0) == (at == "some")


def test_near_dedup_keeps_one_row_of_each_group(docs):
    kept = simhash.representatives(docs).select("doc_id", "text", "rid", "fp").collect()
    assert sum(r.doc_id == 1 for r in kept) == 1
    assert sum(not (r.text or "").split() for r in kept) == 1
    assert all(r.rid == r.fp == 7 for r in kept)


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 1, "assistant", ""), (2, 1, "assistant", "</part></turn>\n### user: #\\"), (2, 2, "assistant", None), (2, 2, "a: b", "x\\")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("end", F.lit(1)).withColumn("before", F.lit(1))
    out = {r.conv_id: r for r in chat.format_chats(turns).select("*", chat.read_turns(F.col("formatted")).alias("back"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(t.role, t.text) for t in out[1].back] == [("", ""), ("user", "a"), ("user", "a")]
    assert out[1].formatted == "### : </turn>\n### user: a</part>a</turn>\n"
    assert [(t.role, t.text) for t in out[2].back] == [("assistant", rows[4][3]), ("a: b", "x\\"), ("assistant", "")]
    assert out[2].loss == rows[4][3] and out[None].loss == ""
    assert chat.report(turns.limit(0)).count() == 0


def test_topk(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (100, [0.5, -1.0]), (3, [1.0, 0.5]), (3, [1.0, 0.5]), (4, None), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, []), (9, [1.0]), (None, [1.0, 1.0]), (200, [1e30, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    out = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.report(v).orderBy("query_id", "rank").collect()]
    top = 2**63 - 1  # the nearest long to what fits none
    assert out == [
        *((0, 1, 200, top), (0, 2, 3, 1310720), (0, 3, 3, 1310720), (0, 4, 100, 0)),
        *((100, 1, 200, top), (100, 2, 0, 0), (100, 3, 3, 0), (100, 4, 3, 0)),
        *((200, 1, 0, top), (200, 2, 3, top), (200, 3, 3, top), (200, 4, 100, top)),
    ]
    assert topk.report(v.limit(0)).count() == 0
    twelve = spark.createDataFrame([(100, [1.0, 2.0])] * 14, "vec_id long, embedding array<float>")
    assert topk.report(twelve).count() == 0
    # a query for each row, also where rows share an id; vectors without components have scores of 0
    twice = spark.createDataFrame([(100, [1.0]), (100, [2.0]), (7, [3.0]), (0, []), (1, [])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.report(twice).collect())) == [(0, 1, 1, 0), (100, 1, 7, 3 << 20), (100, 1, 7, 6 << 20)]
