"""A clip's mode is counted, not found by comparing each frame with each other."""

from palisade.operators import branches as B
from pyspark.sql import functions as F


def test_mode_of_a_long_clip(spark):
    rows = [("a", 0, 9.0, 1, 0.1), ("a", 1, 9.5, 1, 0.1), ("a", 2, 9.0, None, 0.1), ("a", 3, 7.0, 2, 0.1), ("b", 0, 1.0, None, 0.1)]
    short = B.spatial(spark.createDataFrame(rows, "clip_id string, pos int, hotspot double, hot_tile int, noise double"))
    assert {r.clip_id: r.persistence for r in short.collect()} == {"a": 2 / 3, "b": None}
    n = 50_000
    long = spark.range(n).select(F.lit("a").alias("clip_id"), F.col("id").alias("pos"), F.lit(9.0).alias("hotspot"), (F.col("id") % 1000).alias("hot_tile"), F.lit(0.1).alias("noise"))
    assert B.spatial(long).first().persistence == 50 / n
