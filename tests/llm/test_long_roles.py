"""Roles and texts of over a million characters in a chat; repeated ids in the training of languages."""

import hashlib

from pyspark.sql import functions as F

from palisade.llm import chat, langid


def test_long_roles_and_texts(spark):
    role, text = "a:\\#</" * 200_000, "x</turn>\n### \\b: " * 70_000
    rows = [(1, 0, role, "short"), (1, 1, "assistant", text), (2, 0, "user" * 600, "y"), (3, 0, "\\" * 1_000_001, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.report(turns).collect()}
    for conv in (1, 2, 3):
        mine = [(r[2], r[3] or "") for r in rows if r[0] == conv]
        assert out[conv].n_turns == len(mine)
        assert out[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in mine).encode()).hexdigest()
    assert out[1].loss_chars == len(text) and out[1].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_repeated_ids_take_no_share(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "Model", lambda x, langs: seen.append(len(langs)))
    docs = spark.range(1500).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    langid.fit(docs, F.lit(True), 700)
    langid.fit(docs.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(10)))), F.lit(True), 700)
    assert seen == [700, 700]
