"""Evidence fusion: comparable branch scores into one anomaly score with coverage, disagreement and abstention.

Input, one row a clip and branch: clip_id, branch, branch_order, status, score, has_confidence,
confidence_raw, coverage_raw, observed_raw (strings, so that missing, null and malformed stay apart),
fusion_eligible. Clips: clip_id, quality_confounder, detection_frames. All evidence sets are fused in one
pass, with the set as a key. `keys` are what is fused apart: clips, or a clip's windows (clip_id, cell)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import robust as R

#: Weight and evidence group of each branch that takes part.
BRANCHES = {
    "temporal": (1.25, "motion"), "integrity": (1.15, "motion"), "recompression": (1.0, "codec"), "frequency": (0.9, "codec"),
    "codec": (0.55, "codec"), "face": (0.7, "spatial"), "spatial": (0.8, "spatial"), "periodicity": (0.75, "periodicity"),
    "audio": (0.65, "audio"), "avsync": (0.45, "audio"), "wavelet": (0.8, "wavelet"),
}
#: Branches of the two partial evidence sets.
SETS = {
    "legacy": ("temporal", "recompression", "frequency", "face", "spatial", "integrity", "audio"),
    "new_additions": ("periodicity", "codec", "avsync", "wavelet", "resampling"),
}
CLIP = ("clip_id",)
QUALITY_GROUP, NON_FACE_QUALITY = "codec", ("codec", "wavelet")


def branch_dim(spark) -> DataFrame:
    """branch, weight, grp, sets."""
    rows = [(b, w, g, ["all", *(s for s, members in SETS.items() if b in members)]) for b, (w, g) in BRANCHES.items()]
    return spark.createDataFrame(rows, "branch string, weight double, grp string, sets array<string>")


def unit(x: Column) -> Column:
    """x held to [0, 1]; null stays null, which greatest and least alone would skip."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def weighed(branches: DataFrame, clips: DataFrame, keys: Sequence[str] = CLIP) -> DataFrame:
    """Branches that can take part, with `rejected` (why a malformed one can't) and `reliability`."""
    dim = F.broadcast(branch_dim(branches.sparkSession))
    rows = branches.join(dim, "branch").join(clips.select(*keys, "quality_confounder"), [*keys], "left")
    number = lambda c: R.finite(F.col(c).try_cast("double"))
    able = (F.col("status") == "ok") & R.finite("score").isNotNull() & F.coalesce("fusion_eligible", F.lit(True))
    confidence = F.when(~F.col("has_confidence"), 0.5).when(F.col("confidence_raw").isNull(), 0.0).otherwise(number("confidence_raw"))
    coverage = F.when(F.col("coverage_raw").isNull(), 1.0).otherwise(number("coverage_raw"))
    seen = number("observed_raw")
    counted = F.when(F.col("observed_raw").isNull(), coverage).otherwise(F.least(coverage, F.least(F.lit(1.0), seen / 8.0)))
    rejected = (
        F.when(confidence.isNull(), "invalid-confidence")
        .when(coverage.isNull(), "invalid-coverage")
        .when(F.col("observed_raw").isNotNull() & (seen.isNull() | (seen < 0)), "invalid-observation-count")
    )
    held = F.when(F.coalesce("quality_confounder", F.lit(False)) & (F.col("grp") == QUALITY_GROUP), 0.35).otherwise(1.0)
    return (
        rows.where(able)
        .withColumn("rejected", rejected)
        .withColumn("reliability", unit(confidence) * unit(counted) * held)
        .withColumn("score", unit(F.col("score")))
    )


def _by_group(branches: DataFrame, clips: DataFrame, keys: Sequence[str] = CLIP) -> DataFrame:
    """keys, evidence_set, grp with r (the representative, null where no branch takes part), group_weight,
    members, bad (rejected branches)."""
    rows = weighed(branches, clips, keys).withColumn("evidence_set", F.explode("sets"))
    able = F.col("rejected").isNull() & (F.col("reliability") > 0)
    pull = F.col("score") * F.col("reliability") * F.col("weight")
    return rows.groupBy(*keys, "evidence_set", "grp").agg(
        F.max_by(F.struct("branch", "score", "reliability", "weight"), F.when(able, F.struct(pull, -F.col("branch_order")))).alias("r"),
        F.max(F.when(able, F.col("weight"))).alias("group_weight"),
        F.count_if(able).alias("members"),
        F.collect_list(F.when(F.col("rejected").isNotNull(), F.struct("branch", "rejected"))).alias("bad"),
    )


def _direction(score: Column) -> Column:
    return F.when(score >= 0.5, "positive").when(score <= 0.3, "negative").otherwise("neutral")


def group_votes(branches: DataFrame, clips: DataFrame) -> DataFrame:
    """The representative of each clip's evidence groups by set, and its directional vote."""
    score, reliability = F.col("score"), F.col("reliability")
    direction = _direction(score)
    strength = F.when(direction == "neutral", 0.0).otherwise(unit(F.abs(score - 0.5) * 2))
    found = _by_group(branches, clips).where("members > 0").select("clip_id", "evidence_set", "grp", "r.*", "group_weight", "members")
    return found.withColumns({
        "direction": direction,
        "vote": F.when(direction == "positive", 1).when(direction == "negative", -1).otherwise(0),
        "supported": reliability >= 0.30,
        "support": reliability * strength,
    })


def fuse(branches: DataFrame, clips: DataFrame, keys: Sequence[str] = CLIP) -> DataFrame:
    """One row for each of `keys` in clips and evidence set, also for those without evidence."""
    spark = branches.sparkSession
    sets = spark.createDataFrame([("all",), *((s,) for s in SETS)], "evidence_set string")
    base = clips.select(*keys, F.coalesce("quality_confounder", F.lit(False)).alias("confounded"), "detection_frames").crossJoin(F.broadcast(sets))
    one = F.struct("grp", "r.branch", "r.score", "r.reliability", "r.weight", _direction(F.col("r.score")).alias("direction"))
    grouped = _by_group(branches, clips, keys).groupBy(*keys, "evidence_set").agg(
        F.array_sort(F.collect_list(F.when(F.col("members") > 0, one))).alias("groups"),
        F.sum("group_weight").alias("total_weight"),
        F.max("members").alias("most_members"),
        F.flatten(F.collect_list("bad")).alias("bad"),
    )
    df = base.join(grouped, [*keys, "evidence_set"], "left")
    df = df.withColumns({
        "groups": F.when(F.size("groups") > 0, F.col("groups")),
        "rejected_branches": F.when(F.size("bad") > 0, F.map_from_entries(F.array_sort("bad"))),
    })

    # bounded arrays of at most as many groups as there are kinds; steps in an order that lets each use the last
    groups = F.col("groups")
    values = F.transform(groups, lambda g: g["score"])
    weigh = lambda a: F.aggregate(a, F.lit(0.0), lambda s, g: s + g["weight"] * g["reliability"])
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, g: s + g["weight"] * g["reliability"] * g["score"]) / weigh(a)
    any_ = F.col("independent") > 0
    df = df.withColumn("independent", F.coalesce(F.size("groups"), F.lit(0))).withColumn("independent", F.greatest("independent", F.lit(0)))
    df = df.withColumns({
        "base_score": F.when(any_, mean(groups)),
        "coverage": F.when(any_, weigh(groups) / F.col("total_weight")),
        "disagreement": F.when(any_, F.array_max(values) - F.array_min(values)),
        "mid": F.when(any_, R.array_median(values)),
        "group_score_p10": F.when(any_, R.array_percentile(values, 0.1)),
        "group_score_p90": F.when(any_, R.array_percentile(values, 0.9)),
        "only_quality": F.col("confounded") & F.forall(groups, lambda g: g["grp"] == QUALITY_GROUP),
        "positive_groups": F.filter(groups, lambda g: (g["score"] >= 0.35) & (g["reliability"] >= 0.30)),
    })
    df = df.withColumns({
        "group_mad": F.when(any_, R.array_mad(values, F.col("mid"))),
        "penalty": unit((F.col("disagreement") - 0.35) / 0.65),
        "non_quality_positive": F.filter("positive_groups", lambda g: g["grp"] != QUALITY_GROUP),
    })
    df = df.withColumn("quality_sensitive_only", (F.size("positive_groups") > 0) & (F.size("non_quality_positive") == 0))
    df = df.withColumns({
        "non_face_quality_only": F.coalesce(F.col("detection_frames") <= 0, F.lit(False))
        & F.col("confounded") & (F.size("positive_groups") > 0)
        & F.forall("positive_groups", lambda g: g["grp"].isin(*NON_FACE_QUALITY)),
        "backers": F.when(F.col("quality_sensitive_only"), F.col("non_quality_positive")).otherwise(F.col("positive_groups")),
        "instability": unit(0.6 * F.col("disagreement") + 0.4 * F.least(F.lit(1.0), F.col("group_mad") * 4)),
    })
    center = R.array_median(F.transform("backers", lambda g: g["score"]))
    df = df.withColumn("agreeing", F.when(F.size("backers") >= 2, R.let(center, lambda c: F.filter("backers", lambda g: F.abs(g["score"] - c) <= 0.20))).otherwise(F.slice("backers", 1, 0)))
    preserved = (F.size("agreeing") >= 2) & (F.size("agreeing") == F.size("backers"))
    df = df.withColumn("positive_evidence_score", F.when(preserved, mean(F.col("agreeing"))))
    weak = (F.col("independent") < 2) | (F.col("coverage") < 0.20) | (F.col("disagreement") >= 0.80)
    df = df.withColumns({
        "final": F.greatest(F.col("base_score") * (1 - 0.20 * F.col("penalty")), F.col("positive_evidence_score")),
        "abstain": ~any_ | weak | F.col("only_quality") | F.col("non_face_quality_only"),
        "close_groups": F.size(F.filter(groups, lambda g: F.abs(g["score"] - F.col("mid")) <= 0.20)),
        "consensus_groups": F.size(F.filter(groups, lambda g: F.abs(g["score"] - F.col("mid")) <= 0.35)),
        "reliable": F.forall(groups, lambda g: g["reliability"] >= 0.30),
        "n_positive": F.size(F.filter(groups, lambda g: g["direction"] == "positive")),
        "n_negative": F.size(F.filter(groups, lambda g: g["direction"] == "negative")),
    })
    provisional = (
        any_ & ~F.col("abstain") & (F.col("coverage") >= 0.40) & (F.col("mid") >= 0.50) & (F.col("disagreement") <= 0.20)
        & (F.col("close_groups") == F.col("independent")) & F.col("reliable")
    )
    mixed = (F.col("n_positive") > 0) & (F.col("n_negative") > 0)
    why = (
        F.when(~any_, "no-supported-groups")
        .when(provisional, "independent-groups-stable-consensus")
        .when(F.col("independent") < 2, "fewer-than-two-independent-groups")
        .when(F.col("only_quality"), "quality-sensitive-evidence-only")
        .when(F.col("non_face_quality_only"), "non-face-quality-evidence-only")
        .when(F.col("coverage") < 0.40, "insufficient-supported-coverage")
        .when(F.col("mid") < 0.50, "robust-median-below-consensus-floor")
        .when(F.col("disagreement") > 0.20, "independent-groups-do-not-agree")
        .otherwise("independent-groups-lack-reliability")
    )
    label = (
        F.when(F.col("abstain"), "abstain-insufficient-evidence")
        .when(F.col("final") < 0.30, "low-anomaly-signal")
        .when(F.col("final") < 0.62, "mixed-anomaly-signal")
        .otherwise("high-anomaly-signal")
    )
    code = lambda when, name: F.when(when, name)
    reasons = F.array_compact(F.array(
        code(F.col("confounded"), "global-compression-confounder"),
        code(F.col("rejected_branches").isNotNull(), "invalid-branch-reliability"),
        code(~any_, "no-supported-branch"),
        code(any_ & mixed, "mixed-directional-votes"),
        code(F.col("most_members") > 1, "correlated-branches-collapsed"),
        code(any_ & F.col("only_quality"), "only-quality-sensitive-evidence"),
        code(F.col("disagreement") >= 0.55, "independent-evidence-disagrees"),
        code(F.col("quality_sensitive_only"), "quality-sensitive-evidence-only"),
        code(F.col("non_face_quality_only"), "non-face-quality-evidence-only"),
        code(F.col("positive_evidence_score").isNotNull(), "supported-positive-evidence-preserved"),
        code(any_ & F.col("abstain"), "insufficient-independent-evidence"),
    ))
    status = (
        F.when(~any_, "no-supported-groups")
        .when(F.col("independent") < 2, "insufficient-independent-groups")
        .when(F.col("consensus_groups") == F.col("independent"), "consistent")
        .otherwise("mixed")
    )
    votes_status = (
        F.when(~any_, "no-supported-groups").when(mixed, "mixed-directional-votes")
        .when(F.col("n_positive") + F.col("n_negative") > 0, "directionally-consistent").otherwise("directionally-uncertain")
    )
    six = lambda c: F.round(F.col(c), 6)
    return df.select(
        *keys, "evidence_set", label.alias("label"), six("final").alias("score"), F.col("independent").alias("group_count"),
        F.coalesce(F.round(unit(F.col("coverage")), 6), F.lit(0.0)).alias("evidence_coverage"),
        six("mid").alias("stable_anomaly_score"), six("group_mad").alias("robust_group_mad"), six("disagreement").alias("group_score_range"),
        "group_score_p10", "group_score_p90", F.coalesce(six("penalty"), F.lit(0.0)).alias("disagreement_penalty"),
        six("instability").alias("instability_score"), six("positive_evidence_score").alias("positive_evidence_score"),
        F.coalesce("quality_sensitive_only", F.lit(False)).alias("quality_sensitive_only"),
        F.coalesce(provisional, F.lit(False)).alias("provisional_positive"), why.alias("provisional_reason"),
        status.alias("consensus_status"), votes_status.alias("vote_status"),
        F.coalesce("n_positive", F.lit(0)).alias("n_positive"), F.coalesce("n_negative", F.lit(0)).alias("n_negative"),
        F.array_sort(F.array_distinct(reasons)).alias("reason_codes"),
        F.map_from_entries(F.coalesce(F.transform(groups, lambda g: F.struct(g["grp"].alias("grp"), F.round(g["score"], 6).alias("score"))), F.array().cast("array<struct<grp:string,score:double>>"))).alias("group_scores"),
        F.coalesce("rejected_branches", F.create_map().cast("map<string,string>")).alias("rejected_branches"),
    )
