"""Evidence branches: a clip's samples or pairs into one row clip_id, branch, status, score, confidence.

A clip's samples are bounded by the sampling budget, so each branch gathers them once by clip, in arrays, and
all its statistics come from those: one shuffle a branch. Features that need a decoder come in as columns;
without them a branch is unavailable (see palisade.sources.adapters)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import robust as R
from palisade.functions import tiles as T
from palisade.operators import sequence as S

c, pos = R.unit, R.positive


@dataclass(frozen=True)
class Stat:
    """Statistics of an array column, as columns of its frame."""

    n: Column
    med: Column
    mad: Column
    out: Column


def with_stats(df: DataFrame, *names: str) -> DataFrame:
    """Adds <name>_n, _med, _mad and _out for array columns; median and deviation of nothing are null."""
    # as SQL text, which the session parses at once, and in steps for all arrays together: expressions built piece by
    # piece take longer than running them
    one = lambda x: f"get(transform(array(array_sort({x})), s -> (get(s, (size(s) - 1) div 2) + get(s, size(s) div 2)) / 2), 0)"
    middle = lambda x: f"CASE WHEN size({x}) > 0 THEN {one(x)} END"
    df = df.withColumns({a: F.expr(f"filter({a}, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('inf'))") for a in names})
    df = df.withColumns({f"{a}_{s}": F.expr(c) for a in names for s, c in (("n", f"size({a})"), ("med", middle(a)))})
    df = df.withColumns({f"{a}_mad": F.expr(middle(f"transform({a}, v -> abs(v - {a}_med))")) for a in names})
    far = lambda a: f"filter({a}, v -> CASE WHEN {a}_mad < {R.FLOOR}D THEN abs(v - {a}_med) > {R.FLOOR}D ELSE abs(v - {a}_med) > {R.OUTLIER}D * {R.MAD_SCALE}D * {a}_mad END)"
    return df.withColumns({f"{a}_out": F.expr(f"CASE WHEN {a}_n < 3 THEN 0D ELSE size({far(a)}) / {a}_n END") for a in names})


def stat(a: str) -> Stat:
    return Stat(F.col(f"{a}_n"), R.or_zero(F.col(f"{a}_med")), R.or_zero(F.col(f"{a}_mad")), F.col(f"{a}_out"))


def gathered(rows: DataFrame, *features: str, order: str = "pos") -> DataFrame:
    """clip_id and an array of each feature, in order."""
    one = rows.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct(order, *features))).alias("_rows"))
    return with_stats(one.select("clip_id", *(F.col(f"_rows.{f}").cast("array<double>").alias(f) for f in features)), *features)


def row(df: DataFrame, branch: str, score: Column, confidence: Column, supported: Column, *metrics: str, keep: bool = False) -> DataFrame:
    """Score where supported; confidence too, unless it is kept without a score."""
    held = confidence if keep else F.when(supported, confidence).otherwise(0.0)
    return df.select("clip_id", F.lit(branch).alias("branch"), F.lit("ok").alias("status"), F.when(supported, score).alias("score"), held.alias("confidence"), *metrics)


def full(x: Column) -> Column:
    return F.least(F.lit(1.0), x)


def scene(pairs: DataFrame) -> DataFrame:
    """pairs: clip_id, pos, distance. A diagnostic: never a score."""
    df = gathered(pairs, "distance")
    z = lambda d: R.robust_z(d, F.col("distance_med"), F.col("distance_mad"))
    cuts = F.size(F.filter("distance", lambda d: (d >= 0.35) | (z(d) >= 6)))
    df = df.withColumns({"comparisons": F.col("distance_n"), "median_distance": F.col("distance_med"), "max_distance": F.array_max("distance"), "cut_rate": F.try_divide(cuts, F.col("distance_n"))})
    return row(df, "scene", F.lit(None).cast("double"), F.lit(0.0), F.lit(False), "comparisons", "median_distance", "max_distance", "cut_rate")


def temporal(pairs: DataFrame) -> DataFrame:
    """pairs outside cuts: clip_id, pos, gap, error, flow (null without tracked features), local, tracked."""
    df = gathered(pairs, "gap", "error", "flow", "local", "tracked")
    e, f, loc = stat("error"), stat("flow"), stat("local")
    spread = c(e.mad / (e.med + 0.01) * 3)
    parts = 0.25 * c(pos(spread - 0.75) * 2) + 0.20 * c(pos(e.out - 0.20) * 4) + 0.35 * c(pos(f.out - 0.25) * 4) * c((f.n - 8) / 20) + 0.20 * c(pos(loc.out - 0.15) * 4)
    # features tracked in all pairs together
    tracked = F.when(f.n > 0, full(F.aggregate("tracked", F.lit(0.0), lambda a, v: a + v) / 20)).otherwise(1.0)
    return row(df, "temporal", c(parts), full(e.n / 10) * tracked, (e.n >= 3) & (F.col("gap_med") <= 60))


def recompression(frames: DataFrame) -> DataFrame:
    """frames: clip_id, pos, residual, block, ratio."""
    df = gathered(frames, "residual", "block", "ratio")
    r, b, ell = stat("residual"), stat("block"), stat("ratio")
    score = 0.20 * c(4 * r.mad / (r.med + 0.01)) + 0.20 * c(3 * b.mad / (b.med + 0.01)) + 0.25 * c(4 * ell.mad / (R.falsy(F.col("ratio_med"), 1.0) + 0.1)) + 0.20 * ell.out + 0.15 * c((R.falsy(F.col("ratio_med"), 1.0) - 1) / 3)
    return row(df, "recompression", c(score), full(r.n / 8), r.n >= 4)


def frequency(frames: DataFrame) -> DataFrame:
    """frames: clip_id, pos, noise, high, ratio."""
    df = gathered(frames, "noise", "high", "ratio")
    s, h, ell = stat("noise"), stat("high"), stat("ratio")
    middle = R.falsy(F.col("ratio_med"), 1.0)
    score = 0.15 * c(5 * s.mad / (s.med + 0.005)) + 0.20 * c(3 * h.mad / (h.med + 0.01)) + 0.25 * c(4 * ell.mad / (middle + 0.1)) + 0.20 * ell.out + 0.20 * c((middle - 1) / 3)
    return row(df, "frequency", c(score), full(h.n / 8), h.n >= 4)


def face(jumps: DataFrame, clips: DataFrame) -> DataFrame:
    """jumps: clip_id, pos, move, resize, geometry (of a detection; move and resize null for the first); clips:
    clip_id, frames, candidates (median a frame), flow_pairs."""
    df = clips.join(gathered(jumps, "move", "resize", "geometry"), "clip_id", "left")
    m, s = stat("move"), stat("resize")
    mean = R.array_mean(F.col("geometry"))
    spread = R.let(mean, lambda v: F.sqrt(R.array_mean(F.transform("geometry", lambda x: (x - v) * (x - v)))) / (v + 1e-6))
    df = df.withColumn("geometry_cv", R.or_zero(spread))
    score = c(0.35 * m.mad / R.falsy(F.col("move_med"), 0.02) + 0.35 * s.mad / R.falsy(F.col("resize_med"), 0.01) + 0.90 * F.col("geometry_cv"))
    seen = F.coalesce("geometry_n", F.lit(0))
    confidence = full(seen / 12) * full(seen / F.col("frames"))
    supported = (seen >= 4) & (confidence >= 0.3) & (F.col("geometry_cv") >= 0.10) & (score >= 0.25) & (F.col("candidates") <= 3) & (F.col("flow_pairs") >= 3)
    return row(df, "face", score, confidence, supported, "geometry_cv")


def spatial(frames: DataFrame) -> DataFrame:
    """frames: clip_id, pos, hotspot, hot_tile, noise."""
    df = gathered(frames, "hotspot", "hot_tile", "noise")
    seen = frames.groupBy("clip_id", R.finite("hot_tile").alias("tile")).agg(F.count("*").alias("k")).where("tile IS NOT NULL")
    df = df.join(seen.groupBy("clip_id").agg(F.max("k").alias("mode_count")), "clip_id", "left")
    h = stat("hotspot")
    df = df.withColumn("persistence", F.try_divide(F.col("mode_count"), F.col("hot_tile_n")))
    local, steady = c((h.med - 2) / 8), c((F.col("persistence") - 0.15) / 0.55)
    df = df.withColumns({"localized": local, "raw": c(0.55 * local * steady + 0.45 * local * c((h.mad / (h.med + 0.001)) / 2))})
    supported = (h.n >= 4) & (F.col("raw") >= 0.25) & (F.col("localized") >= 0.45) & (F.col("persistence") >= 0.75) & (R.or_zero(F.col("noise_med")) < 0.12)
    return row(df, "spatial", F.col("raw"), full(h.n / 8), supported, "persistence")


def integrity(pairs: DataFrame) -> DataFrame:
    """pairs: clip_id, pos, residual, divergence, occlusion, contrast, without (contrast less its hottest tile), dct."""
    df = gathered(pairs, "residual", "divergence", "occlusion", "contrast", "without", "dct")
    r, d, o, ell, q, w = (stat(x) for x in ("residual", "divergence", "occlusion", "contrast", "dct", "without"))
    raw = c(0.25 * c(pos(r.out - 0.15) * 3.5) + 0.20 * c(d.med / 2.5) + 0.20 * c(pos(o.med - 0.04) * 3) + 0.20 * c(pos(ell.out - 0.15) * 3.5) + 0.15 * c(4 * q.mad / (q.med + 0.001)))
    return row(df, "integrity", raw * full(0.5 + c(w.med / R.falsy(F.col("contrast_med"), 1.0))), full(r.n / 8), r.n >= 4)


def periodicity(frames: DataFrame) -> DataFrame:
    """frames: clip_id, pos from 0, signature (an array)."""
    n = F.count("*").over(Window.partitionBy("clip_id"))
    rows = S.pairs(frames.withColumn("n", n), ["clip_id"], "pos", "signature")
    pairs = rows.where(F.col("previous").isNotNull()).select("clip_id", "pos", S.l1(F.col("previous"), F.col("signature")).alias("change"))
    rate = S.lag_matches(frames.withColumn("n", n), ["clip_id"], "pos", "signature", lambda a, b: S.l1(a, b) <= 1.0, "n").groupBy("clip_id").agg(F.max("match_rate").alias("rate"))
    run = R.longest_run(pairs.withColumn("flag", F.col("change") <= 0.65), ["clip_id"], "pos", "flag")
    df = gathered(pairs, "change").join(run, "clip_id").join(rate, "clip_id", "left")
    m = stat("change")
    burst, motion = c((F.col("longest_run") - 1.0) / F.greatest(F.lit(2.0), m.n * 0.35)), c((m.med - 0.65) / 3)
    score = c(0.55 * burst + 0.45 * R.or_zero(F.col("rate")) * motion)
    supported = (m.n >= 3) & (F.col("longest_run") >= 3) & (motion >= 0.2) & (score >= 0.25)
    return row(df, "periodicity", score, full((m.n + 1) / 12), supported, "longest_run")


def wavelet(frames: DataFrame, width: int, cuts: DataFrame | None = None) -> DataFrame:
    """frames: clip_id, pos, frame_index, tiles (row-major, of even sides)."""
    bands = T.haar(F.col("tiles"), width)
    scale = T.mean_abs(bands["ll"])
    energies = F.array(*(T.mean_abs(b) / (scale + 1e-6) for b in bands.values()))
    rows = frames.select("clip_id", "pos", "frame_index", energies.alias("energy"), F.transform(bands["hh"], lambda v: F.abs(v)).alias("detail"))
    by = Window.partitionBy("clip_id").orderBy("pos")
    change = F.zip_with("detail", F.lag("detail").over(by), lambda a, b: F.abs(a - b))
    pairs = rows.select("clip_id", "pos", "frame_index", F.lag("frame_index").over(by).alias("before"), S.l1(F.col("energy"), F.lag("energy").over(by)).alias("delta"), change.alias("moved")).where("before IS NOT NULL")
    pairs = pairs.withColumn("local", T.contrast(F.col("moved"), 1e-6))
    if cuts is not None:
        kept = S.outside_cuts(pairs, cuts, ["clip_id"], "before", "frame_index", "cut")
        left = kept.select("clip_id").distinct()
        # a clip whose pairs all touch cuts keeps them all
        pairs_used = kept.unionByName(pairs.join(left, "clip_id", "left_anti"))
    else:
        pairs_used = pairs
    used = gathered(pairs_used, "delta")
    every = gathered(pairs.select("clip_id", "pos", F.col("delta").alias("step"), "local"), "step", "local").select("clip_id", "step", "local", "step_n")
    df = used.join(every, "clip_id")
    d = stat("delta")
    spread = d.mad + 1e-6
    events = F.size(F.filter("step", lambda v: (v > d.med + 4.0 * spread) & (v > F.greatest(F.lit(0.02), d.med * 2.5))))
    local = F.size(F.filter("local", lambda v: v > 4.0))
    score = c(0.45 * c(d.mad / (d.med + 0.01) * 2) + 0.30 * c(events / F.greatest(F.lit(2.0), d.n * 0.25)) + 0.25 * c(local / F.greatest(F.lit(2.0), F.size("local") * 0.25)))
    confidence = full(full(d.n / 8) * F.when(events > 0, 1.0).otherwise(0.6))
    return row(df.withColumn("events", events), "wavelet", score, confidence, (d.n >= 4) & (score >= 0.35), "events", keep=True)


def wavelet_levels(frames: DataFrame, width: int) -> DataFrame:
    """clip_id, frames and the median energy of each band of the second Haar level, which goes over the first one's `ll`;
    diagnostics only, the score has the first level."""
    # the first level comes to be once, before what is made of it
    first = frames.select("clip_id", T.haar(F.col("tiles"), width)["ll"].alias("ll"))
    scale = T.mean_abs(F.col("ll")) + 1e-6
    rows = first.select("clip_id", *((T.mean_abs(b) / scale).alias(f"level2_{n}") for n, b in T.haar(F.col("ll"), width // 2).items()))
    names = [c for c in rows.columns if c != "clip_id"]
    return rows.groupBy("clip_id").agg(F.count("*").alias("frames"), *(F.round(F.percentile(c, F.lit(0.5)), 6).alias(c) for c in names))


def resampling(frames: DataFrame) -> DataFrame:
    """frames: clip_id, pos, signature. A diagnostic score that never takes part in fusion."""
    rows = S.pairs(frames, ["clip_id"], "pos", "signature")
    one = rows.where(F.col("previous").isNotNull()).select("clip_id", "pos", S.l1(F.col("previous"), F.col("signature")).alias("change"))
    inner = rows.where(F.col("previous").isNotNull() & F.col("following").isNotNull())
    middle = F.zip_with("previous", "following", lambda a, b: (a + b) / 2)
    motion = S.l1(F.col("previous"), F.col("following")) + 0.05
    second = inner.select("clip_id", "pos", (S.l1(F.col("signature"), middle) / motion).alias("residual"), motion.alias("motion"))
    run = R.longest_run(one.withColumn("flag", F.col("change") <= 0.65), ["clip_id"], "pos", "flag")
    df = gathered(second, "residual", "motion").join(run, "clip_id")
    r = stat("residual")
    floor = r.med - F.greatest(2.0 * (r.mad + 1e-6), F.lit(0.12))
    events = F.size(F.filter(F.arrays_zip("residual", "motion"), lambda x: (x["residual"] < floor) & (x["motion"] > 1.0)))
    score = c(0.45 * c(events / F.greatest(F.lit(2.0), r.n * 0.20)) + 0.35 * c((r.med - 1) / 2) + 0.20 * c((F.col("longest_run") - 1) / F.greatest(F.lit(2.0), (r.n + 1) * 0.30)))
    df = df.withColumns({"diagnostic_score": score, "fusion_eligible": F.lit(False)})
    return row(df, "resampling", F.lit(None).cast("double"), full((r.n + 2) / 16), F.lit(False), "diagnostic_score", "fusion_eligible", keep=True)


def codec(frames: DataFrame) -> DataFrame:
    """frames: clip_id, pos, key (boolean), seconds, of at least eight frames."""
    by = Window.partitionBy("clip_id").orderBy("pos")
    keys = frames.where("key").withColumn("gap", (F.col("pos") - F.lag("pos").over(by)).cast("double"))
    gaps = gathered(keys.where("gap IS NOT NULL"), "gap")
    steps = gathered(frames.withColumn("step", F.col("seconds") - F.lag("seconds").over(by)).where("step IS NOT NULL"), "step")
    n = frames.groupBy("clip_id").agg(F.count("*").alias("frames")).where("frames >= 8")
    df = n.join(gaps, "clip_id", "left").join(steps, "clip_id", "left")
    cv = R.or_zero(F.col("gap_mad")) / R.falsy(F.col("gap_med"), 1.0)
    jitter = R.or_zero(F.col("step_mad")) / R.falsy(F.col("step_med"), 1.0)
    some = R.or_zero(F.col("gap_n").cast("double")) > 0
    df = df.withColumn("some", some)
    out = row(df, "codec", c(0.7 * c(cv * 4) + 0.3 * c(jitter * 8)), full(F.col("frames") / 60), F.col("some") & (F.col("frames") >= 12), "frames", "some", keep=True)
    return out.withColumn("confidence", F.when(F.col("some"), F.col("confidence")).otherwise(0.0)).drop("some")


def avsync(streams: DataFrame) -> DataFrame:
    """streams: clip_id, video_start, audio_start, video_duration, audio_duration."""
    start, length = F.abs(F.col("video_start") - F.col("audio_start")), F.abs(F.col("video_duration") - F.col("audio_duration"))
    off = F.coalesce((start >= 0.35) & (length >= 0.5), F.lit(False))
    score = c(0.65 * c((start - 0.35) / 1.5) + 0.35 * c((length - 0.5) / 3))
    return row(streams, "avsync", score, F.lit(0.7), off)


def audio(windows: DataFrame) -> DataFrame:
    """windows: clip_id, pos, rms, centroid, clipping."""
    by = Window.partitionBy("clip_id").orderBy("pos")
    level = F.log(F.col("rms") + 1e-4)
    rows = windows.withColumns({"jump": F.abs(level - F.lag(level).over(by)), "turn": F.abs(F.col("centroid") - F.lag("centroid").over(by))})
    df = gathered(rows, "jump", "turn", "clipping", "rms")
    j, s = stat("jump"), stat("turn")
    clipping = R.or_zero(R.array_mean(F.col("clipping")))
    df = df.withColumn("discontinuity", c(2 * pos(j.out - 0.15) + 2 * pos(s.out - 0.15) + 20 * pos(clipping - 0.01)))
    score = c(0.35 * c(pos(j.med - 0.15) * 3 + 8 * j.mad) + 0.25 * c(pos(s.med - 0.01) * 20 + 30 * s.mad) + 0.40 * F.col("discontinuity"))
    n = F.col("rms_n")
    return row(df, "audio", score, full(n / 8), (n >= 4) & (F.col("discontinuity") >= 0.25), "discontinuity")


@dataclass(frozen=True)
class Branch:
    """What the registry knows of a branch: its name, its place in ties, and how to make its rows."""

    name: str
    order: int
    make: Callable[..., DataFrame]


REGISTRY = {
    name: Branch(name, k, f)
    for k, (name, f) in enumerate(
        (("scene", scene), ("temporal", temporal), ("recompression", recompression), ("frequency", frequency), ("face", face), ("spatial", spatial), ("integrity", integrity),
         ("periodicity", periodicity), ("wavelet", wavelet), ("resampling", resampling), ("codec", codec), ("avsync", avsync), ("audio", audio))
    )
}


def union(*rows: DataFrame) -> DataFrame:
    """Branch rows of several branches, with branch_order; what only some of them report stays out."""
    order = F.create_map(*(F.lit(x) for b in REGISTRY.values() for x in (b.name, b.order)))
    common = ["clip_id", "branch", "status", "score", "confidence"]
    out = rows[0].select(*common)
    for r in rows[1:]:
        out = out.unionByName(r.select(*common))
    return out.withColumn("branch_order", order[F.col("branch")])
