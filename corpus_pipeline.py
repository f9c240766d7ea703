"""A training corpus from raw documents in five stages, each one operator of palisade.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs. All but the last keep the columns of documents, whatever else these hold and whatever their
names. doc_id is a number or null, and may repeat; texts may be of any length; without documents each stage returns no
rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import bpe, decontaminate, quality, simhash, suffix
from palisade.llm.common import shared_path, table
from palisade.llm.queries import vocabulary


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, doesn't reject. Each row is judged
    by its own text, a null or empty one too; without labels none is rejected."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents but those with a similarity of 0.8 or more, in five-word shingles, to one that stays; of near copies that of
    the smallest doc_id stays (null ids first; of rows of one id that of the smallest text). Null, empty and blank texts are
    near copies of each other."""
    return simhash.representatives(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeat earlier ones, in the same order of rows. All rows stay; a null text stays
    null, one that goes whole becomes empty."""
    return suffix.remove(docs)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items don't contaminate. Null and empty texts have no words and stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document, one row a row; a null or empty text has none."""
    ids = bpe.encoded(docs, vocabulary("byte_bpe_50k.json"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_filter", benchmark_filter),
    ("encode", encode),
]

#: The classifier's training can't be put in SQL; tests/llm/test_pipeline_brute.py holds run() against its stages done
#: plainly.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
