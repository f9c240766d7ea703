"""Localized events: rows from index lists, clusters of near events, support by time bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Metrics that hold frame indexes, and what an index in each is called.
KINDS = {
    "cut_indices": "scene-cut", "abrupt_transition_indices": "temporal-transition", "observation_indices": "face-region-observation",
    "keyframe_indices": "keyframe", "instability_indices": "wavelet-instability", "interpolation_event_indices": "interpolation-residual",
    "duplicate_residual_indices": "duplicate-residual",
}
#: Key frames are listed, but no evidence in clusters.
CLUSTERED = tuple(k for k in KINDS if k != "keyframe_indices")


def events(metrics: DataFrame, clips: DataFrame) -> DataFrame:
    """clip_id, branch, metric, kind, frame_index, ts from rows (clip_id, branch, metric, indices); ts is null
    for a clip without a frame rate."""
    kinds = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    rows = metrics.select("clip_id", "branch", "metric", kinds[F.col("metric")].alias("kind"), F.explode("indices").alias("frame_index")).where("kind IS NOT NULL AND frame_index IS NOT NULL")
    at = F.round(F.col("frame_index") / F.nullif(F.col("fps"), F.lit(0.0)), 6)
    return rows.join(clips.select("clip_id", "fps"), "clip_id", "left").withColumn("ts", at).drop("fps")


def clusters(rows: DataFrame, tolerance: int = 2) -> DataFrame:
    """clip_id, start_frame, end_frame, branch_count, event_count, branches of each run of events whose gaps are
    at most `tolerance`."""
    order = Window.partitionBy("clip_id").orderBy("frame_index", "branch", "metric")
    new = (F.col("frame_index") - F.lag("frame_index").over(order) > tolerance).cast("int")
    marked = rows.where(F.col("metric").isin(*CLUSTERED)).withColumn("new", F.coalesce(new, F.lit(1)))
    numbered = marked.withColumn("cluster", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("clip_id", "cluster").agg(
        F.min("frame_index").alias("start_frame"), F.max("frame_index").alias("end_frame"),
        F.count_distinct("branch").alias("branch_count"), F.count("*").alias("event_count"), F.array_sort(F.collect_set("branch")).alias("branches"),
    )


def alignment(rows: DataFrame, clips: DataFrame, tolerance: int = 2) -> DataFrame:
    """A clip's time-aligned evidence: score and confidence from clusters that more than one branch supports."""
    found = clusters(rows, tolerance)
    shared = F.col("branch_count") >= 2
    per = found.groupBy("clip_id").agg(
        F.sum("event_count").alias("event_count"), F.count("*").alias("clusters"), F.count_if(shared).alias("coincident"),
        F.coalesce(F.max(F.when(shared, F.col("branch_count"))), F.lit(0)).alias("most"),
    )
    most, none = F.col("most") / 3.0, F.col("event_count").isNull()
    score = F.when(none, None).when(F.col("coincident") == 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), most) * F.least(F.lit(1.0), F.col("coincident") / F.col("clusters")), 6))
    status = F.when(none, "no-localized-events").when(F.col("coincident") > 0, "cross-branch-supported").otherwise("events-not-coincident")
    return clips.select("clip_id").join(per, "clip_id", "left").select(
        "clip_id", status.alias("status"), F.coalesce("event_count", F.lit(0)).alias("event_count"), F.coalesce("coincident", F.lit(0)).alias("coincident_event_count"),
        F.coalesce("most", F.lit(0)).alias("supporting_branch_count"), score.alias("score"),
        F.coalesce(F.round(F.least(F.lit(1.0), most * F.least(F.lit(1.0), F.col("event_count") / 8.0)), 6), F.lit(0.0)).alias("confidence"),
    )


def bins(rows: DataFrame, clips: DataFrame) -> DataFrame:
    """clip_id, bucket, branch_count, start_seconds, end_seconds of time bins that two branches or more support.
    Without a frame rate a bin is a frame and has no seconds."""
    width = F.when(F.coalesce("duration_seconds", F.lit(0.0)) > 0, F.greatest(F.lit(1.0), F.col("duration_seconds") / 12.0)).otherwise(1.0)
    timed = rows.join(clips.select("clip_id", "duration_seconds"), "clip_id", "left").withColumn("width", width)
    bucket = F.when(F.col("ts").isNull(), F.col("frame_index")).otherwise(F.floor(F.col("ts") / F.col("width"))).cast("long")
    per = timed.groupBy("clip_id", bucket.alias("bucket"), F.col("ts").isNull().alias("untimed"), "width").agg(F.count_distinct("branch").alias("branch_count"))
    seconds = lambda k: F.when(~F.col("untimed"), F.round((F.col("bucket") + k) * F.col("width"), 6))
    return per.where("branch_count >= 2").select("clip_id", "bucket", "branch_count", seconds(0).alias("start_seconds"), seconds(1).alias("end_seconds"))


def support(rows: DataFrame, clips: DataFrame) -> DataFrame:
    """clip_id, consensus_event_count, supporting_branch_count, event_branch_count, support_fraction."""
    total = rows.groupBy("clip_id").agg(F.count_distinct("branch").alias("event_branch_count"))
    best = bins(rows, clips).groupBy("clip_id").agg(F.count("*").alias("consensus_event_count"), F.max("branch_count").alias("supporting_branch_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = clips.select("clip_id").join(total, "clip_id", "left").join(best, "clip_id", "left")
    share = F.coalesce(F.round(F.col("supporting_branch_count") / F.col("event_branch_count"), 6), F.lit(0.0))
    return out.select("clip_id", zero("consensus_event_count"), zero("supporting_branch_count"), zero("event_branch_count"), share.alias("support_fraction"))


def segments(branches: DataFrame, clips: DataFrame, samples: DataFrame) -> DataFrame:
    """Clip-wide evidence: a row for each scored branch, from 0 to the clip's end."""
    rows = branches.where(F.col("score").isNotNull()).join(clips.select("clip_id", "duration_seconds"), "clip_id").join(samples, "clip_id", "left")
    return rows.select("clip_id", "branch", F.lit(0.0).alias("start_seconds"), F.round("duration_seconds", 6).alias("end_seconds"), "score", "sample_count")
