"""Sessions and tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; `partitions` shuffle partitions if given."""
    builder = SparkSession.builder.master(master).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else one set before, else, in local runs, an own one."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="palisade-")
    if not held.isDefined():
        context.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """df's rows as they are now, in the shared folder, so that a task that runs again finds the same rows in the same
    partitions."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Bytes and rows of pixels that Python works on at a time, and what an Arrow batch holds.
BATCH_BYTES, PIXEL_ROWS = 8 << 20, 64


def bounded(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python workers receive by bytes too: as many rows of pixels as Spark puts in a batch by
    number alone are gigabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Bytes of freed memory that a task's process keeps, and of a block beyond which it is the system's own: places of mallopt's values.
KEPT, OWN = (-1, 256 << 20), (-3, 32 << 20)


def roomy(run: Callable) -> Callable:
    """A function of Arrow batches whose process keeps what it frees until the task ends. Arrays of a frame's size otherwise go
    back to the system each time, and pages come anew for each operation, which took most of some operations' time."""

    def task(batches: Iterator) -> Iterator:
        library = ctypes.CDLL(None)
        tuned, trim = (getattr(library, n, None) for n in ("mallopt", "malloc_trim"))  # where the C library has them
        if tuned:
            for place, value in (KEPT, OWN):
                tuned(place, value)
        try:
            yield from run(batches)
        finally:
            if trim:
                trim(0)

    return task
