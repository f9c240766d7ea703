"""What the corpus operators share: the shared folder, Arrow batch size, row identity, splits."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: what a Python worker holds of its input at a time.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def prepare(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; an own one only where that
    is unset (local runs, tests). Also bounds the Arrow batches that Python workers receive."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    folder = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if not folder:
        has = jsc.getCheckpointDir()
        if has.isDefined():
            folder = has.get()
        elif spark.sparkContext.master.startswith("local"):
            folder = "file://" + tempfile.mkdtemp(prefix="palisade-")
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def trimmed(run: Callable) -> Callable:
    """A function of Arrow batches that gives memory back to the system when a task ends, as Python workers go on to
    tasks of other stages."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim:
                trim(0)

    return task


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path under the shared folder."""
    return f"{prepare(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


#: Bytes of text in memory for a byte of Catalyst's estimate, which counts Parquet files as they are (measured on
#: the documents table: 2.5).
EXPANSION = 3


def partitions(df: DataFrame, each: int = 64 << 20) -> int:
    """How many partitions to deal df into: the session's number, or more where by Catalyst's estimate of df's
    size a partition would be over `each` bytes of text, as tasks hold a partition of some shuffles in memory."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return least if size >= 1 << 60 else max(least, -(-size * EXPANSION // each))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(n: int):
    """crc32 of doc_id as text, modulo n; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def numbered(docs: DataFrame, *columns: str) -> DataFrame:
    """docs' columns and `rid`, a unique long that follows the order of doc_id.

    Where doc_id is unique and never null it is rid itself, found by a scan of that column alone.
    Otherwise rows are sorted by (doc_id, text), nulls first, and numbered; the sorted rows are
    checkpointed, so that a recomputed task sees the same numbers."""
    kept = docs.select("doc_id", *columns)
    if "rid" in kept.columns:
        raise ValueError("rid is the name of the row's number")
    again = (
        docs.groupBy("doc_id").count().where((F.col("count") > 1) | F.col("doc_id").isNull()).limit(1).count()
    )
    if not again:
        return kept.withColumn("rid", F.col("doc_id"))
    prepare(docs.sparkSession)
    return (
        kept.orderBy("doc_id", "text").withColumn("rid", F.monotonically_increasing_id()).checkpoint()
    )


def renamed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns under names that clash with nothing (_0, _1, ...), in their order."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *(docs[f"`{c}`"].alias(f"_{k}") for k, c in enumerate(others)))


def named(docs: DataFrame, like: DataFrame) -> DataFrame:
    """renamed(like)'s columns back under like's names and in its order."""
    others = [c for c in like.columns if c not in ("doc_id", "text")]
    new = {c: f"_{k}" for k, c in enumerate(others)}
    return docs.select(*(docs[new.get(c, c)].alias(c) for c in like.columns))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return batch.column(column).cast(pa.binary()).fill_null(b"").to_pylist()


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
    )


def slices(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about `most` bytes, or one row; whole rows always."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, int(rows * most / max(batch.nbytes, 1)))
        for at in range(0, rows, step):
            yield batch.slice(at, step)
