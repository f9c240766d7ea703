"""Rare languages teach however many languages there are."""

from pyspark.sql import functions as F

from palisade.llm import langid


def learned(spark, sizes, most, monkeypatch):
    """Rows of each language that a fit over sizes[lang] documents a language learns from."""
    seen = {}
    monkeypatch.setattr(langid, "Model", lambda x, langs: seen.update({v: langs.count(v) for v in langs}))
    of = F.element_at(F.array(*(F.lit(v) for v, n in sizes.items() for _ in range(n))), (F.col("doc_id") + 1).cast("int"))
    docs = spark.range(sum(sizes.values())).withColumnRenamed("id", "doc_id").select("doc_id", of.alias("lang"), F.lit("some text").alias("text"))
    langid.fit(docs, F.lit(True), most)
    return seen


def test_each_language_has_its_share(spark, monkeypatch):
    common = {f"l{k:02}": 600 for k in range(20)}
    got = learned(spark, common | {"rare": 30}, 800, monkeypatch)
    assert got["rare"] == 30 and sum(got.values()) == 800
    assert {got[v] for v in common} <= {38, 39}
    assert learned(spark, {"a": 3000, "b": 20}, 800, monkeypatch) == {"a": 780, "b": 20}
