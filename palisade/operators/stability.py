"""How far a clip's score depends on the window looked at and on the sampling budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import robust as R

#: Bounds of a stable group, of low and of high evidence, of the range of window scores.
TOLERANCE, LOW, HIGH, WIDE = 0.20, 0.30, 0.50, 0.35


def grid(clips: DataFrame, windows: list[int], budgets: list[int]) -> DataFrame:
    """clip_id, window_seconds, budget, start_frame, end_frame, sample_count: centered windows that fit a clip
    (clip_id, fps, frame_count, duration_seconds), for each budget. The grid itself is a handful of rows."""
    cells = [(w, b) for w in sorted({max(1, int(v)) for v in windows}) for b in sorted({max(4, int(v)) for v in budgets})]
    small = clips.sparkSession.createDataFrame(cells, "window_seconds int, budget int")
    rows = clips.where("fps > 0 AND frame_count >= 2 AND duration_seconds > 0").crossJoin(F.broadcast(small))
    rows = rows.where(F.col("duration_seconds") + 1e-6 >= F.col("window_seconds"))
    begin = F.greatest(F.lit(0.0), (F.col("duration_seconds") - F.col("window_seconds")) / 2)
    last = F.col("frame_count") - 1
    rows = rows.withColumns({
        "start_frame": F.least(last, F.rint(begin * F.col("fps")).cast("long")),
        "end_frame": F.least(last, F.rint((begin + F.col("window_seconds")) * F.col("fps")).cast("long") - 1),
    })
    rows = rows.where("end_frame > start_frame")
    taken = F.least(F.col("budget").cast("long"), F.col("end_frame") - F.col("start_frame") + 1)
    return rows.select("clip_id", "window_seconds", "budget", "start_frame", "end_frame", taken.alias("sample_count"))


def sampled(cells: DataFrame, frames: DataFrame) -> DataFrame:
    """Rows of frames (clip_id, pos) in each cell's sample, evenly spread over its window."""
    n = F.col("end_frame") - F.col("start_frame")
    step = n / F.nullif(F.col("sample_count") - 1, F.lit(0))
    place = F.transform(F.sequence(F.lit(0).cast("long"), F.col("sample_count") - 1), lambda i: F.when(i == F.col("sample_count") - 1, F.col("end_frame")).otherwise(F.floor(F.col("start_frame") + i * step)).cast("long"))
    wanted = cells.select("clip_id", "window_seconds", "budget", F.explode(F.array_distinct(place)).alias("pos"))
    return wanted.join(frames.withColumn("pos", F.col("pos").cast("long")), ["clip_id", "pos"])


def cuts_within(cells: DataFrame, cuts: DataFrame) -> DataFrame:
    """cells with `cut`, one row for each cut (clip_id, cut) from the window's first frame to its last; null where there
    is none. An equi-join on the clip: a clip's windows are a handful."""
    named = cuts.withColumnRenamed("clip_id", "_clip")
    inside = (F.col("clip_id") == F.col("_clip")) & F.col("cut").between(F.col("start_frame"), F.col("end_frame"))
    return cells.join(named, inside, "left").drop("_clip")


def quorum(scored: Column, windows: Column, budgets: Column) -> dict[str, Column]:
    """How many evaluations have to agree."""
    need = F.when(scored <= 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(scored * 0.6)))
    return {
        "required_count": need.cast("int"),
        "required_fraction": F.coalesce(F.round(F.try_divide(need, scored), 6), F.lit(0.0)),
        "reduced_scope": (budgets > 0) & (budgets < 3),
        "limited_windows": windows < 2,
    }


def group_stability(scores: DataFrame, scored: DataFrame) -> DataFrame:
    """clip_id, grp, samples, support, mid, mad, spread, stable, negative, positive. scores: clip_id, cell, grp,
    score; scored: clip_id, n, required_count, required_fraction."""
    one = scores.groupBy("clip_id", "grp").agg(F.count("*").alias("samples"), R.median("score").alias("mid"), (F.max("score") - F.min("score")).alias("spread"))
    two = scores.join(one.select("clip_id", "grp", "mid"), ["clip_id", "grp"]).groupBy("clip_id", "grp").agg(F.percentile(F.abs(F.col("score") - F.col("mid")), F.lit(0.5)).alias("mad"))
    rows = one.join(two, ["clip_id", "grp"]).join(scored.select("clip_id", "n", "required_count", "required_fraction"), "clip_id")
    support = F.col("samples") / F.col("n")
    stable = (F.col("samples") >= F.col("required_count")) & (support >= F.col("required_fraction")) & (F.col("spread") <= TOLERANCE)
    return rows.select(
        "clip_id", "grp", "samples", F.round(support, 6).alias("support"), F.round("mid", 6).alias("mid"), F.round("mad", 6).alias("mad"), F.round("spread", 6).alias("spread"),
        stable.alias("stable"), (stable & (F.col("mid") <= LOW)).alias("negative"), (stable & (F.col("mid") >= HIGH)).alias("positive"),
    )


def decision(cells: DataFrame, groups: DataFrame, windows: int, budgets: int) -> DataFrame:
    """One row a clip: spread of its cells' scores, support for stable low or high evidence, and why.

    cells: clip_id, cell, score, stable_score, provisional; groups: clip_id, cell, grp, score. Also returns
    stable_positive_score, which downstream rules read."""
    scored = cells.where(R.finite("score").isNotNull())
    # a clip has as many cells as the grid and a few groups in each: all of a clip's statistics come from these
    # two bounded arrays, so that cells are gathered once
    own = scored.groupBy("clip_id").agg(F.collect_list(F.struct("cell", "score", "stable_score", "provisional")).alias("cells"))
    theirs = groups.groupBy("clip_id").agg(F.collect_list(F.struct("cell", "grp", "score")).alias("groups"))
    df = own.join(theirs, "clip_id", "left").withColumn("groups", F.coalesce("groups", F.array().cast(theirs.schema["groups"].dataType)))
    scores = F.col("cells.score")
    df = df.withColumns({
        "n": F.size("cells").cast("long"), "score_median": R.array_median(scores), "score_mad": R.array_mad(scores), "score_range": F.array_max(scores) - F.array_min(scores),
        "agreed": F.filter("cells", lambda x: x["provisional"]),
    })
    df = df.withColumns(quorum(F.col("n"), F.lit(windows), F.lit(budgets)))

    def by(key: str) -> Column:
        """samples, mid and spread of the scores of each value of key."""
        of = lambda k: F.transform(F.filter("groups", lambda x: x[key] == k), lambda x: x["score"])
        one = lambda s: F.struct(F.size(s).alias("samples"), R.array_median(s).alias("mid"), (F.array_max(s) - F.array_min(s)).alias("spread"))
        return F.transform(F.array_distinct(F.col(f"groups.{key}")), lambda k: R.let(of(k), one))

    enough = lambda k: (k >= F.col("required_count")) & (k / F.col("n") >= F.col("required_fraction"))
    df = df.withColumns({
        "stable": F.filter(by("grp"), lambda x: enough(x["samples"]) & (x["spread"] <= TOLERANCE)),
        "windows": F.filter(by("cell"), lambda x: (x["samples"] >= 2) & (x["spread"] <= TOLERANCE)),
    })
    low, high = lambda x: x["mid"] <= LOW, lambda x: x["mid"] >= HIGH
    middle = lambda f: R.array_median(F.transform(F.filter("stable", f), lambda x: F.round(x["mid"], 6)))
    count = lambda a, f: F.size(F.filter(a, f)).cast("long")
    df = df.withColumns({
        "negative_groups": count("stable", low), "positive_groups": count("stable", high), "negative_count": count("windows", low), "positive_count": count("windows", high),
        "stable_negative_score": middle(low), "stable_positive_score": middle(high),
        "consensus_count": F.size("agreed").cast("long"), "consensus_median": R.array_median(F.col("agreed.stable_score")),
    })
    df = df.withColumns({
        "stable_negative_support": F.coalesce((F.col("negative_groups") >= 2) & enough(F.col("negative_count")) & (F.col("stable_negative_score") <= LOW), F.lit(False)),
        "group_positive": F.coalesce((F.col("positive_groups") >= 2) & enough(F.col("positive_count")) & (F.col("stable_positive_score") >= HIGH), F.lit(False)),
    })
    df = df.withColumns({
        "exploratory_positive_support": F.col("group_positive") & (F.col("score_range") < WIDE),
        "provisional_positive_support": F.col("group_positive") & enough(F.col("consensus_count")) & (F.col("score_range") < WIDE),
    })
    reason = (
        F.when(F.col("stable_negative_support"), "stable-low-independent-group-consensus")
        .when(F.col("provisional_positive_support"), "stable-positive-independent-group-consensus")
        .when(F.col("score_range") >= WIDE, "window-scores-unstable")
        .otherwise("insufficient-window-consensus")
    )
    six = lambda c: F.round(F.col(c), 6).alias(c)
    index = F.round(F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), F.col("score_range") / 0.5)), 6)
    return df.select(
        "clip_id", "n", "required_count", six("score_median"), six("score_mad"), six("score_range"), index.alias("stability_index"), "consensus_count", six("consensus_median"),
        "negative_groups", "positive_groups", "negative_count", "positive_count", six("stable_negative_score"), six("stable_positive_score"),
        "stable_negative_support", "exploratory_positive_support", "provisional_positive_support", reason.alias("decision_reason"),
    )


def apply_consensus(fused: DataFrame, decided: DataFrame) -> DataFrame:
    """Takes back a provisional positive that windows don't support; notes stable low evidence."""
    rows = fused.join(decided.select("clip_id", "provisional_positive_support", "stable_negative_support"), "clip_id", "left")
    checked = F.col("provisional_positive_support").isNotNull()
    support, low = F.coalesce("provisional_positive_support", F.lit(False)), F.coalesce("stable_negative_support", F.lit(False))
    reason = (
        F.when(checked & F.col("provisional_positive") & ~support, "window-consensus-not-stable")
        .when(checked & F.col("provisional_positive"), "independent-groups-and-windows-stable-consensus")
        .otherwise(F.col("provisional_reason"))
    )
    codes = F.when(low, F.array_sort(F.array_union("reason_codes", F.array(F.lit("stable-negative-evidence"))))).otherwise(F.col("reason_codes"))
    rows = rows.withColumns({"provisional_reason": reason, "reason_codes": codes})
    return rows.withColumn("provisional_positive", F.col("provisional_positive") & (support | ~checked)).drop("provisional_positive_support", "stable_negative_support")


def robustness_abstention(fused: DataFrame, decided: DataFrame, transcode: DataFrame) -> DataFrame:
    """Fragile scores abstain: a wide range over windows, or a change after re-encoding (clip_id, transcode_status)."""
    rows = fused.join(decided.select("clip_id", "score_range", "stable_negative_support"), "clip_id", "left").join(transcode, "clip_id", "left")
    wide = F.coalesce(F.col("score_range") >= WIDE, F.lit(False))
    changed = F.coalesce(F.col("transcode_status") == "unstable", F.lit(False))
    spared = F.coalesce("stable_negative_support", F.lit(False)) & ~changed
    new = F.when(~(wide | changed), F.array().cast("array<string>")).when(spared, F.array(F.lit("stable-negative-evidence"))).otherwise(
        F.array_compact(F.array(F.when(wide, "stability-instability"), F.when(changed, "transcode-instability")))
    )
    label = F.when((wide | changed) & ~spared & (F.col("label") != "abstain-insufficient-evidence"), "abstain-unstable-evidence").otherwise(F.col("label"))
    rows = rows.withColumns({"label": label, "reason_codes": F.array_sort(F.array_union("reason_codes", new))})
    return rows.drop("score_range", "stable_negative_support", "transcode_status")


def transcode_check(before: DataFrame, after: DataFrame) -> DataFrame:
    """clip_id, score_delta, transcode_status from scores before and after re-encoding."""
    rows = before.select("clip_id", F.col("score").alias("a")).join(after.select("clip_id", F.col("score").alias("b")), "clip_id")
    delta = F.abs(F.col("a") - F.col("b"))
    status = F.when(delta.isNull(), "unavailable").when(delta < 0.20, "stable").otherwise("unstable")
    return rows.select("clip_id", F.round(delta, 6).alias("score_delta"), status.alias("transcode_status"))
