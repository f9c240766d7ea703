"""Queries of projections and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.catalogue import query
from palisade.operators import project as P
from palisade.plans.fusion import FUSED_SQL, fused
from palisade.plans.standins import branch_results, clips

#: Labels of the stand-in specialist that say synthetic.
MADE = ("ai_generated",)

_ROUTERS = """, pr AS (
  SELECT clip_id, 'specialist' AS source, (clip_id % 50) / 50.0::DOUBLE AS a, (1 - (clip_id % 50) / 50.0::DOUBLE) * 0.75 AS b, 'ai_generated' AS la, 'real' AS lb FROM clips
  UNION ALL SELECT clip_id, 'binary', (clip_id * 7 % 40) / 40.0::DOUBLE, 1 - (clip_id * 7 % 40) / 40.0::DOUBLE, 'synthetic', 'original' FROM clips
), rg AS (
  SELECT clip_id, source, greatest(a, b) AS top, greatest(a, b) - least(a, b) AS lead, CASE WHEN a > b OR (a = b AND la < lb) THEN la ELSE lb END AS l FROM pr
), ro AS (SELECT clip_id, source, CASE WHEN top >= 0.7 AND lead >= 0.15 THEN 'classified' ELSE 'abstain' END AS status, CASE WHEN top >= 0.7 AND lead >= 0.15 THEN l ELSE 'unknown' END AS label, top, lead FROM rg)
"""
_LABEL = "CASE WHEN abstain THEN 'abstain-insufficient-evidence' WHEN final < 0.3 THEN 'low-anomaly-signal' WHEN final < 0.62 THEN 'mixed-anomaly-signal' ELSE 'high-anomaly-signal' END"


def routers(spark, sf_dir):
    """clip_id, source, status, label, confidence, margin of two routers' stand-in probabilities."""
    k = F.col("clip_id")
    a, b = (k % 50) / 50.0, (k * 7 % 40) / 40.0
    maps = F.map_from_arrays(
        F.array(F.lit("specialist"), F.lit("binary")),
        F.array(F.create_map(F.lit("ai_generated"), a, F.lit("real"), (1 - a) * 0.75), F.create_map(F.lit("synthetic"), b, F.lit("original"), 1 - b)),
    )
    rows = clips(spark, sf_dir).select("clip_id", F.explode(maps).alias("source", "probabilities"))
    return rows.select("clip_id", "source", P.router_gate(F.col("probabilities")).alias("r")).select("clip_id", "source", "r.*")


def whole(spark, sf_dir):
    return fused(spark, sf_dir).where("evidence_set = 'all'")


@query(FUSED_SQL + """, lay(layer, branch) AS (VALUES ('layer1_provenance', 'provenance'), ('layer1_provenance', 'codec'), ('layer1_provenance', 'recompression'), ('layer2_temporal', 'temporal'),
  ('layer2_temporal', 'scene'), ('layer2_temporal', 'periodicity'), ('layer3_face_integrity', 'face'), ('layer3_face_integrity', 'integrity'), ('layer3_face_integrity', 'spatial'),
  ('layer4_frequency_audio', 'frequency'), ('layer4_frequency_audio', 'wavelet'), ('layer4_frequency_audio', 'audio'), ('layer4_frequency_audio', 'avsync'), ('layer5_fusion', 'fusion')),
sc AS (SELECT clip_id, branch, score FROM br UNION ALL SELECT clip_id, 'fusion', round(final, 6) FROM f WHERE evidence_set = 'all')
SELECT c.clip_id, l.layer, round(avg(sc.score), 6) AS score FROM clips c CROSS JOIN (SELECT DISTINCT layer FROM lay) l JOIN lay ON lay.layer = l.layer
LEFT JOIN sc ON sc.clip_id = c.clip_id AND sc.branch = lay.branch AND sc.score BETWEEN 0 AND 1 GROUP BY c.clip_id, l.layer
""")
def five_layer(spark, sf_dir):
    return P.five_layers(branch_results(spark, sf_dir), whole(spark, sf_dir))


@query(FUSED_SQL + _ROUTERS + "SELECT clip_id, source, status, label, round(top, 4) AS confidence, round(lead, 4) AS margin FROM ro")
def router_gate(spark, sf_dir):
    return routers(spark, sf_dir)


@query(FUSED_SQL + _ROUTERS + "SELECT clip_id, source, CASE WHEN coalesce(detection_frames, 0) < 4 THEN 'abstain' ELSE status END AS status FROM ro JOIN clips USING (clip_id)")
def router_abstention(spark, sf_dir):
    rows = routers(spark, sf_dir).join(clips(spark, sf_dir).select("clip_id", "detection_frames"), "clip_id")
    return rows.select("clip_id", "source", P.face_gate(F.col("status"), F.col("detection_frames")).alias("status"))


_RECONCILE = FUSED_SQL + _ROUTERS + ", fl AS (SELECT clip_id, " + _LABEL + """ AS label, final FROM f WHERE evidence_set = 'all'),
sg AS (
  SELECT clip_id, 'deterministic' AS source, CASE WHEN label LIKE 'abstain-%' THEN 'uncertain' WHEN label = 'high-anomaly-signal' THEN 'synthetic' WHEN label = 'low-anomaly-signal' THEN 'original' ELSE 'uncertain' END AS signal FROM fl
  UNION ALL SELECT clip_id, source, CASE WHEN label IN ('ai_generated', 'synthetic') THEN 'synthetic' WHEN label = 'original' THEN 'original' ELSE 'uncertain' END FROM ro WHERE status = 'classified'
), rc AS (
  SELECT clip_id, count(DISTINCT signal) FILTER (WHERE signal <> 'uncertain') AS k, max(signal) FILTER (WHERE signal <> 'uncertain') AS s, max(signal) FILTER (WHERE source = 'deterministic') AS own,
         string_agg(source, ',' ORDER BY source) FILTER (WHERE signal <> 'uncertain') AS src FROM sg GROUP BY clip_id
), rs AS (SELECT *, CASE WHEN k > 1 THEN 'conflict' WHEN k = 1 AND own <> 'uncertain' THEN 'agreed' ELSE 'inconclusive' END AS status FROM rc)
"""


@query(_RECONCILE + "SELECT clip_id, status, CASE WHEN status = 'agreed' THEN s ELSE 'review' END AS decision, CASE WHEN status = 'conflict' THEN src ELSE '' END AS conflicting_sources FROM rs")
def reconcile(spark, sf_dir):
    out = P.reconcile(whole(spark, sf_dir), routers(spark, sf_dir), MADE)
    return out.select("clip_id", "status", "decision", F.array_join("conflicting_sources", ",").alias("conflicting_sources"))


@query(_RECONCILE + "SELECT clip_id, CASE WHEN status = 'agreed' THEN s ELSE 'review' END AS decision, status AS decision_status, status = 'conflict' AS flagged FROM rs")
def fused_decision(spark, sf_dir):
    rows = whole(spark, sf_dir)
    out = P.attach(rows, P.reconcile(rows, routers(spark, sf_dir), MADE))
    return out.select("clip_id", "decision", "decision_status", F.array_contains("reason_codes", "cross-system-conflict").alias("flagged"))
