"""Where branches see something: the frame indexes that their metrics carry, from the same rows that make their scores.

Each function gives clip_id, branch, metric, frame_index; index_lists() makes of them the lists that reports hold and
localize.events() takes. Medians and deviations are a clip's own, over one window by clip; a clip's rows are those of its sample."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import robust as R
from palisade.functions import tiles as T
from palisade.operators import sequence as S

#: A cut by distance or by deviation; a burst by deviations and by size; an interpolated frame; a repeated one; a large
#: residual; a transition.
CUT, CUT_Z, BURST, BURST_FLOOR, BURST_RATIO, FAINT, FAINT_LEAST, MOVING, SAME, TRANSITION = 0.35, 6.0, 4.0, 0.02, 2.5, 2.0, 0.12, 1.0, 0.65, 6.0
#: Values that a transition needs before it.
BEFORE = 5


def _spread(rows: DataFrame, x: str) -> tuple[DataFrame, Column, Column]:
    """rows with the median and deviation of a column by clip, and these."""
    by = Window.partitionBy("clip_id")
    rows = rows.withColumn("_med", F.percentile(R.finite(x), F.lit(0.5)).over(by))
    rows = rows.withColumn("_mad", F.percentile(F.abs(R.finite(x) - F.col("_med")), F.lit(0.5)).over(by))
    return rows, F.col("_med"), F.col("_mad")


def _named(rows: DataFrame, branch: str, metric: str, at: str = "frame_index") -> DataFrame:
    return rows.select("clip_id", F.lit(branch).alias("branch"), F.lit(metric).alias("metric"), F.col(at).cast("long").alias("frame_index"))


def scene_cuts(pairs: DataFrame) -> DataFrame:
    """pairs: clip_id, frame_index, distance from the frame before."""
    rows, med, mad = _spread(pairs, "distance")
    x = F.col("distance")
    return _named(rows.where((x >= CUT) | (R.robust_z(x, med, mad) >= CUT_Z)), "scene", "cut_indices")


def wavelet_bursts(frames: DataFrame, width: int) -> DataFrame:
    """frames: clip_id, pos, frame_index, tiles. Frames at which the bands' energies jump."""
    bands = T.haar(F.col("tiles"), width)
    scale = T.mean_abs(bands["ll"])
    energy = F.array(*(T.mean_abs(b) / (scale + 1e-6) for b in bands.values()))
    by = Window.partitionBy("clip_id").orderBy("pos")
    one = frames.select("clip_id", "pos", "frame_index", energy.alias("energy"))
    rows, med, mad = _spread(one.withColumn("x", S.l1(F.col("energy"), F.lag("energy").over(by))).where("x IS NOT NULL"), "x")
    return _named(rows.where((F.col("x") > med + BURST * (mad + 1e-6)) & (F.col("x") > F.greatest(F.lit(BURST_FLOOR), med * BURST_RATIO))), "wavelet", "instability_indices")


def resampling_events(frames: DataFrame) -> DataFrame:
    """frames: clip_id, pos, frame_index, signature. Frames that look like blends of their neighbours, and frames that repeat the
    one before."""
    rows = S.pairs(frames, ["clip_id"], "pos", "signature")
    repeated = rows.where(S.l1(F.col("previous"), F.col("signature")) <= SAME)
    middle = F.zip_with("previous", "following", lambda a, b: (a + b) / 2)
    motion = S.l1(F.col("previous"), F.col("following")) + 0.05
    inner = rows.where(F.col("previous").isNotNull() & F.col("following").isNotNull())
    second = inner.select("clip_id", "frame_index", motion.alias("motion"), (S.l1(F.col("signature"), middle) / motion).alias("x"))
    faint, med, mad = _spread(second, "x")
    faint = faint.where((F.col("x") < med - F.greatest(FAINT * (mad + 1e-6), F.lit(FAINT_LEAST))) & (F.col("motion") > MOVING))
    return _named(faint, "resampling", "interpolation_event_indices").unionByName(_named(repeated, "resampling", "duplicate_residual_indices"))


def key_frames(frames: DataFrame) -> DataFrame:
    """frames: clip_id, pos, key."""
    return _named(frames.where("key"), "codec", "keyframe_indices", "pos")


def face_observations(found: DataFrame) -> DataFrame:
    """found: clip_id, frame_index, region, as pixels.detections gives them."""
    return _named(found.where("region IS NOT NULL"), "face", "observation_indices")


def transitions(pairs: DataFrame) -> DataFrame:
    """pairs: clip_id, pos, frame_index, error, as pixels.temporal_pairs gives them. Errors far over those of the pairs before."""
    before = Window.partitionBy("clip_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = pairs.where("error IS NOT NULL").withColumn("past", F.array_sort(F.collect_list("error").over(before)))
    rows = rows.where(F.size("past") >= BEFORE).withColumn("c", R.array_median(F.col("past")))
    rows = rows.withColumn("m", R.array_mad(F.col("past"), F.col("c")))
    return _named(rows.where(R.robust_z(F.col("error"), F.col("c"), F.col("m")) > TRANSITION), "temporal", "abrupt_transition_indices")


def index_lists(*events: DataFrame) -> DataFrame:
    """clip_id, branch, metric, indices (sorted)."""
    rows = reduce(DataFrame.unionByName, events)
    return rows.groupBy("clip_id", "branch", "metric").agg(F.array_sort(F.collect_list("frame_index")).alias("indices"))
