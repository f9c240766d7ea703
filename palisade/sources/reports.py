"""Report files as they come: JSON whose branches and fields aren't known beforehand, kept as VARIANT, and what the evaluator
takes of them.

A field that is missing, one that is null in JSON and one that is no number are three things in the report; as a number all
three are none. Text that spells a number counts as one, as do true and false. What is no object where one is expected has
no fields. Names of branches come from the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators import evaluate

NUMBER, TEXT, FLAG, WHOLE = "double", "string", "boolean", "int"
#: What the evaluator reads of a report beside its evidence: column, place, kind.
FIELDS = (
    ("stability_enabled", "stability.enabled", FLAG), ("stability_status", "stability.status", TEXT), ("score_range", "stability.score_range", NUMBER),
    ("stable_negative_support", "stability.stable_negative_support", FLAG), ("stable_negative_score", "stability.stable_negative_score", NUMBER),
    ("provisional_positive_support", "stability.provisional_positive_support", FLAG), ("exploratory_positive_support", "stability.exploratory_positive_support", FLAG),
    ("feasible_windows", "stability.consensus_policy.feasible_window_count", WHOLE), ("requested_budgets", "stability.consensus_policy.requested_budget_count", WHOLE),
    ("transcode_enabled", "transcode_stability.enabled", FLAG), ("transcode_status", "transcode_stability.status", TEXT),
    ("cut_rate", "branches.scene.metrics.cut_rate", NUMBER), ("temporal_score", "branches.temporal.score", NUMBER),
    ("face_score", "branches.face.score", NUMBER), ("geometry_cv", "branches.face.metrics.geometry_cv", NUMBER), ("detection_rate", "branches.face.metrics.detection_rate", NUMBER),
    ("integrity_score", "branches.integrity.score", NUMBER), ("frequency_score", "branches.frequency.score", NUMBER),
)
EVIDENCE = (
    ("score", NUMBER), ("label", TEXT), ("group_score_range", NUMBER), ("evidence_coverage", NUMBER), ("instability_score", NUMBER), ("provisional_positive", FLAG),
)


def parsed(text: Column) -> Column:
    """A report of JSON text; null where it is none."""
    return F.try_parse_json(text)


def files(spark: SparkSession, path: str) -> DataFrame:
    """name (of the file, without folder and suffix), path and report of JSON files in UTF-8, with or without a mark, or
    UTF-16 by its mark."""
    raw = F.col("content")
    text = (
        F.when(F.hex(F.substring(raw, 1, 2)).isin("FFFE", "FEFF"), F.decode(raw, "UTF-16"))
        .when(F.hex(F.substring(raw, 1, 3)) == "EFBBBF", F.decode(F.substring(raw, 4, 2**31 - 1), "UTF-8"))
        .otherwise(F.decode(raw, "UTF-8"))
    )
    found = spark.read.format("binaryFile").load(path)
    return found.select(F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1).alias("name"), "path", parsed(text).alias("report"))


def field(report: Column | str, place: str, kind: str) -> Column:
    """The value at a place (names with dots between them), null where there is none of that kind."""
    value = F.try_variant_get(report, "$." + place, kind)
    if kind != NUMBER:
        return value
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def presence(report: Column | str, place: str) -> Column:
    """missing, null or present: what stands at a place."""
    at = F.variant_get(report, "$." + place, "variant")
    return F.when(at.isNull(), "missing").when(F.is_variant_null(at), "null").otherwise("present")


def flat(reports: DataFrame, evidence_set: str = "all") -> DataFrame:
    """The rows that evaluate.classify takes (name and reports' other columns beside it), judged by one of the evidence sets:
    all of it, a fused set, or the directional score."""
    if evidence_set not in evaluate.EVIDENCE_SETS:
        raise ValueError(f"evidence_set must be one of {', '.join(evaluate.EVIDENCE_SETS)}")
    held = [c for c in reports.columns if c not in ("report", "path")]
    more = {c: field("report", place, kind) for c, place, kind in FIELDS}
    ambiguity = F.coalesce(*(F.when(presence("report", f"branches.face.metrics.{n}") != "missing", F.struct(field("report", f"branches.face.metrics.{n}", NUMBER).alias("v"))) for n in ("candidate_ambiguity", "median_candidates_per_frame")))
    view = "fusion" if evidence_set in ("all", "directional") else f"fusion_sets.{evidence_set}"
    evidence = {c: field("report", f"{view}.{c}", kind) for c, kind in EVIDENCE}
    codes = F.coalesce(F.try_variant_get("report", f"$.{view}.reason_codes", "array<string>"), F.array().cast("array<string>"))
    votes = field("report", f"{view}.directional_vote_summary.status", TEXT)
    out = reports.select(*held, *(c.alias(n) for n, c in {**evidence, **more}.items()), ambiguity["v"].alias("ambiguity"), codes.alias("reason_codes"), votes.alias("vote_status"))
    if evidence_set != "directional":
        return out
    judged = evaluate.directional(out)
    none = {c: F.lit(None).cast(t) for c, t in (("group_score_range", "double"), ("instability_score", "double"), ("provisional_positive", "boolean"))}
    own = {"score": F.col("directional_score"), "label": F.lit("directional-synthetic-evidence"), "evidence_coverage": F.col("n_qualifying") / 2.0}
    return judged.withColumns(own | none).drop("directional_score")


def branch_rows(reports: DataFrame) -> DataFrame:
    """name, expected, branch, score for every branch that a report names, whatever is under that name."""
    branches = F.variant_get("report", "$.branches", "variant")
    some = reports.where(F.schema_of_variant(branches).startswith("OBJECT")).select("name", "expected", branches.alias("branches"))
    exploded = some.lateralJoin(some.sparkSession.tvf.variant_explode(F.col("branches").outer()))
    return exploded.select("name", "expected", F.col("key").alias("branch"), field("value", "score", NUMBER).alias("score"))
