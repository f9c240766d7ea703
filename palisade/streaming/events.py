"""Event operators over a stream of rows clip_id, branch, ts (timestamp), value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bin_support(events: DataFrame, width: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Time bins that two branches or more support, as they close: clip_id, start, end, branch_count, event_count."""
    counted = (
        events.withWatermark("ts", late)
        .groupBy("clip_id", F.window("ts", width))
        # streams have no exact distinct count; the set of a bin's branches is bounded by the registry
        .agg(F.size(F.collect_set("branch")).alias("branch_count"), F.count("*").alias("event_count"))
    )
    return counted.where("branch_count >= 2").select("clip_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "branch_count", "event_count")


def sessions(events: DataFrame, gap: str = "2 seconds", late: str = "1 minute") -> DataFrame:
    """Runs of events no further apart than the gap, in time rather than in frames, that two branches or more share."""
    grouped = (
        events.withWatermark("ts", late)
        .groupBy("clip_id", F.session_window("ts", gap))
        .agg(F.size(F.collect_set("branch")).alias("branch_count"), F.count("*").alias("event_count"))
    )
    return grouped.where("branch_count >= 2").select("clip_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "branch_count", "event_count")


def running_summary(events: DataFrame) -> DataFrame:
    """Counts, means and clipped shares of each clip so far; an aggregate in update mode."""
    return events.groupBy("clip_id").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread"), F.avg((F.abs("value") >= 100).cast("int")).alias("clipped")
    )
