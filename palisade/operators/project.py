"""Projections of reports: evidence layers, router gates, and reconciliation of independent outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Branches whose scores a layer averages; the last layer is the fused score.
LAYERS = {
    "layer1_provenance": ("provenance", "codec", "recompression"), "layer2_temporal": ("temporal", "scene", "periodicity"),
    "layer3_face_integrity": ("face", "integrity", "spatial"), "layer4_frequency_audio": ("frequency", "wavelet", "audio", "avsync"), "layer5_fusion": ("fusion",),
}
#: Least probability and lead of a router's label, detections that face routers need.
CONFIDENCE, MARGIN, DETECTIONS = 0.70, 0.15, 4


def five_layers(branches: DataFrame, fused: DataFrame) -> DataFrame:
    """clip_id, layer, score: five rows a clip; a layer without a valid score is null."""
    dim = [(layer, b) for layer, members in LAYERS.items() for b in members]
    layers = branches.sparkSession.createDataFrame(dim, "layer string, branch string")
    scores = branches.select("clip_id", "branch", "score").unionByName(fused.select("clip_id", F.lit("fusion").alias("branch"), "score"))
    valid = scores.where(F.col("score").between(0.0, 1.0)).join(F.broadcast(layers), "branch")
    means = valid.groupBy("clip_id", "layer").agg(F.round(F.avg("score"), 6).alias("score"))
    every = fused.select("clip_id", F.explode(F.array(*map(F.lit, LAYERS))).alias("layer"))
    return every.join(means, ["clip_id", "layer"], "left")


def router_gate(probabilities: Column) -> Column:
    """A struct status, label, confidence, margin from a map of label probabilities; null for an empty map. A
    single label leads by its own probability; equal ones go by the label."""
    valid = F.filter(F.map_entries(probabilities), lambda e: e["value"].between(0.0, 1.0))
    ranked = F.array_sort(F.transform(valid, lambda e: F.struct((-e["value"]).alias("p"), e["key"].alias("label"))))
    top = -F.get(ranked, F.lit(0))["p"]
    lead = top + F.coalesce(F.get(ranked, F.lit(1))["p"], F.lit(0.0))
    sure = (top >= CONFIDENCE) & (lead >= MARGIN)
    return F.when(
        F.size(ranked) > 0,
        F.struct(
            F.when(sure, "classified").otherwise("abstain").alias("status"), F.when(sure, F.get(ranked, F.lit(0))["label"]).otherwise("unknown").alias("label"),
            F.round(top, 4).alias("confidence"), F.round(lead, 4).alias("margin"),
        ),
    )


def face_gate(status: Column, detections: Column) -> Column:
    """A face router abstains for clips without repeated detections."""
    return F.when(F.coalesce(detections, F.lit(0.0)) < DETECTIONS, "abstain").otherwise(status)


def reconcile(fused: DataFrame, routers: DataFrame, made: Sequence[str] = ("synthetic",), binary: Sequence[str] = ("synthetic", "original")) -> DataFrame:
    """clip_id, status, consensus, decision, conflicting_sources. fused: clip_id, label, score; routers: clip_id,
    source (specialist or binary), status, label. made: labels of the specialist that say synthetic; binary: the
    labels of the other router that say synthetic and original. The fused score stays authoritative; nothing is
    overridden. The score of a mixed label doesn't count, as it is rounded: one just under a bound would be over it."""
    score = F.col("score")
    own = (
        F.when(F.col("label").startswith("abstain-") | (F.col("label") == "mixed-anomaly-signal"), "uncertain")
        .when((F.col("label") == "high-anomaly-signal") | (score >= 0.62), "synthetic")
        .when((F.col("label") == "low-anomaly-signal") | (score < 0.30), "original")
        .otherwise("uncertain")
    )
    label = F.col("label")
    theirs = F.when(F.col("source") == "specialist", F.when(label.isin(*made), "synthetic").otherwise("uncertain")).otherwise(
        F.when(label == binary[0], "synthetic").when(label == binary[1], "original").otherwise("uncertain")
    )
    signals = fused.select("clip_id", F.lit("deterministic").alias("source"), own.alias("signal")).unionByName(
        routers.where("status = 'classified'").select("clip_id", "source", theirs.alias("signal"))
    )
    told = F.col("signal") != "uncertain"
    rows = signals.groupBy("clip_id").agg(
        F.collect_set(F.when(told, F.col("signal"))).alias("signals"), F.array_sort(F.collect_list(F.when(told, F.col("source")))).alias("sources"),
        F.max(F.when(F.col("source") == "deterministic", F.col("signal"))).alias("own"),
    )
    status = F.when(F.size("signals") > 1, "conflict").when((F.size("signals") == 1) & (F.col("own") != "uncertain"), "agreed").otherwise("inconclusive")
    consensus = F.when(status == "agreed", F.get("signals", F.lit(0))).otherwise("review")
    conflicting = F.when(status == "conflict", F.col("sources")).otherwise(F.array().cast("array<string>"))
    return rows.select("clip_id", status.alias("status"), consensus.alias("consensus"), consensus.alias("decision"), conflicting.alias("conflicting_sources"))


def attach(fused: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Adds decision and decision_status, and a reason code for a conflict."""
    rows = fused.join(reconciled.select("clip_id", F.col("status").alias("decision_status"), "decision"), "clip_id", "left")
    rows = rows.withColumns({"decision": F.coalesce("decision", F.lit("review")), "decision_status": F.coalesce("decision_status", F.lit("inconclusive"))})
    codes = F.when(F.col("decision_status") == "conflict", F.array_sort(F.array_union("reason_codes", F.array(F.lit("cross-system-conflict"))))).otherwise(F.col("reason_codes"))
    return rows.withColumn("reason_codes", codes)
