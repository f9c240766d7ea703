"""Queries of evidence fusion, on branch results made from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.catalogue import query
from palisade.operators import fusion
from palisade.plans.standins import BRANCH_SQL, branch_results, clips

#: SQL from branch results to the representatives of groups (rep) by clip, set and group.
REP_SQL = "WITH " + BRANCH_SQL + """, w(branch, weight, grp) AS (
  VALUES ('temporal', 1.25, 'motion'), ('integrity', 1.15, 'motion'), ('recompression', 1.0, 'codec'), ('frequency', 0.9, 'codec'), ('codec', 0.55, 'codec'),
         ('face', 0.7, 'spatial'), ('spatial', 0.8, 'spatial'), ('periodicity', 0.75, 'periodicity'), ('audio', 0.65, 'audio'), ('wavelet', 0.8, 'wavelet')
), es(evidence_set, branch) AS (
  SELECT 'all', branch FROM w UNION ALL
  SELECT 'legacy', branch FROM w WHERE branch IN ('temporal', 'recompression', 'frequency', 'face', 'spatial', 'integrity', 'audio') UNION ALL
  SELECT 'new_additions', branch FROM w WHERE branch IN ('periodicity', 'codec', 'wavelet')
), c0 AS (
  SELECT br.clip_id, br.branch, branch_order, CAST(weight AS DOUBLE) AS weight, grp, score, quality_confounder,
         CASE WHEN NOT has_confidence THEN 0.5::DOUBLE WHEN confidence_raw IS NULL THEN 0.0::DOUBLE ELSE TRY_CAST(confidence_raw AS DOUBLE) END AS conf,
         CASE WHEN coverage_raw IS NULL THEN 1.0::DOUBLE ELSE TRY_CAST(coverage_raw AS DOUBLE) END AS cov, TRY_CAST(observed_raw AS DOUBLE) AS obs
  FROM br JOIN w USING (branch) JOIN clips USING (clip_id) WHERE status = 'ok' AND fusion_eligible
), c1 AS (
  SELECT *, CASE WHEN conf IS NULL THEN 'invalid-confidence' WHEN cov IS NULL THEN 'invalid-coverage' END AS rejected,
         conf * CASE WHEN obs IS NULL THEN cov ELSE least(cov, obs / 8) END * CASE WHEN quality_confounder AND grp = 'codec' THEN 0.35::DOUBLE ELSE 1 END AS rel
  FROM c0
), cand AS (SELECT c1.*, evidence_set FROM c1 JOIN es USING (branch) WHERE rejected IS NULL AND rel > 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY clip_id, evidence_set, grp ORDER BY score * rel * weight DESC, branch_order) AS k,
         max(weight) OVER (PARTITION BY clip_id, evidence_set, grp) AS gw, count(*) OVER (PARTITION BY clip_id, evidence_set, grp) AS members
  FROM cand
), rep AS (SELECT * FROM ranked WHERE k = 1)
"""

#: SQL of the fused rows (f), after REP_SQL.
FUSED_SQL = REP_SQL + """, a AS (
  SELECT clip_id, evidence_set, count(*) AS g, sum(weight * rel * score) / sum(weight * rel) AS base, sum(weight * rel) / sum(gw) AS cov,
         max(score) - min(score) AS dis, quantile_cont(score, 0.5) AS mid, quantile_cont(score, 0.1) AS p10, quantile_cont(score, 0.9) AS p90,
         max(members) AS members, count(*) FILTER (WHERE grp <> 'codec') AS non_codec, bool_and(rel >= 0.3) AS reliable,
         count(*) FILTER (WHERE score >= 0.35 AND rel >= 0.3) AS npos, count(*) FILTER (WHERE score >= 0.35 AND rel >= 0.3 AND grp <> 'codec') AS npos_nq,
         count(*) FILTER (WHERE score >= 0.35 AND rel >= 0.3 AND grp NOT IN ('codec', 'wavelet')) AS npos_face,
         count(*) FILTER (WHERE score >= 0.5) AS vp, count(*) FILTER (WHERE score <= 0.3) AS vn
  FROM rep GROUP BY clip_id, evidence_set
), m AS (
  SELECT clip_id, evidence_set, quantile_cont(abs(score - mid), 0.5) AS mad, count(*) FILTER (WHERE abs(score - mid) <= 0.2) AS near20,
         count(*) FILTER (WHERE abs(score - mid) <= 0.35) AS near35
  FROM rep JOIN a USING (clip_id, evidence_set) GROUP BY clip_id, evidence_set
), pos AS (
  SELECT rep.* FROM rep JOIN a USING (clip_id, evidence_set) WHERE score >= 0.35 AND rel >= 0.3 AND npos_nq > 0
), pc AS (SELECT clip_id, evidence_set, quantile_cont(score, 0.5) AS c FROM pos GROUP BY clip_id, evidence_set),
pe AS (
  SELECT clip_id, evidence_set, CASE WHEN count(*) >= 2 AND bool_and(abs(score - c) <= 0.2) THEN sum(weight * rel * score) / sum(weight * rel) END AS pes
  FROM pos JOIN pc USING (clip_id, evidence_set) GROUP BY clip_id, evidence_set
), rj AS (SELECT clip_id, evidence_set, count(*) AS n_rejected FROM c1 JOIN es USING (branch) WHERE rejected IS NOT NULL GROUP BY clip_id, evidence_set),
b AS (
  SELECT clips.clip_id, s.evidence_set, quality_confounder AS qc, detection_frames, a.* EXCLUDE (clip_id, evidence_set), mad, near20, near35, pes, n_rejected,
         g IS NULL AS nothing, coalesce(qc AND non_codec = 0, false) AS only_quality, coalesce(npos > 0 AND npos_nq = 0, false) AS qso,
         coalesce(detection_frames <= 0 AND qc AND npos > 0 AND npos_face = 0, false) AS nfq
  FROM clips CROSS JOIN (SELECT DISTINCT evidence_set FROM es) s
  LEFT JOIN a ON a.clip_id = clips.clip_id AND a.evidence_set = s.evidence_set
  LEFT JOIN m ON m.clip_id = clips.clip_id AND m.evidence_set = s.evidence_set
  LEFT JOIN pe ON pe.clip_id = clips.clip_id AND pe.evidence_set = s.evidence_set
  LEFT JOIN rj ON rj.clip_id = clips.clip_id AND rj.evidence_set = s.evidence_set
), f0 AS (
  SELECT *, CASE WHEN NOT nothing THEN greatest(base * (1 - 0.2 * greatest(0.0, least(1.0, (dis - 0.35) / 0.65))), coalesce(pes, 0)) END AS final,
         nothing OR g < 2 OR cov < 0.2 OR dis >= 0.8 OR only_quality OR nfq AS abstain
  FROM b
), f AS (
  SELECT *, NOT abstain AND cov >= 0.4 AND mid >= 0.5 AND dis <= 0.2 AND near20 = g AND reliable AS prov FROM f0
)
"""

_SELECT = """
SELECT clip_id, evidence_set,
  CASE WHEN abstain THEN 'abstain-insufficient-evidence' WHEN final < 0.3 THEN 'low-anomaly-signal' WHEN final < 0.62 THEN 'mixed-anomaly-signal' ELSE 'high-anomaly-signal' END AS label,
  round(final, 6) AS score, CAST(coalesce(g, 0) AS INTEGER) AS group_count, CASE WHEN nothing THEN 0 ELSE round(least(1.0, cov), 6) END AS evidence_coverage, round(mid, 6) AS stable_anomaly_score,
  round(mad, 6) AS robust_group_mad, round(dis, 6) AS group_score_range, round(p10, 6) AS group_score_p10, round(p90, 6) AS group_score_p90,
  CASE WHEN nothing THEN 0 ELSE round(greatest(0.0, least(1.0, (dis - 0.35) / 0.65)), 6) END AS disagreement_penalty,
  CASE WHEN NOT nothing THEN round(greatest(0.0, least(1.0, 0.6 * dis + 0.4 * least(1.0, mad * 4))), 6) END AS instability_score, round(pes, 6) AS positive_evidence_score, qso AS quality_sensitive_only,
  prov IS NOT NULL AND prov AS provisional_positive,
  CASE WHEN nothing THEN 'no-supported-groups' WHEN prov THEN 'independent-groups-stable-consensus' WHEN g < 2 THEN 'fewer-than-two-independent-groups'
       WHEN only_quality THEN 'quality-sensitive-evidence-only' WHEN nfq THEN 'non-face-quality-evidence-only' WHEN cov < 0.4 THEN 'insufficient-supported-coverage'
       WHEN mid < 0.5 THEN 'robust-median-below-consensus-floor' WHEN dis > 0.2 THEN 'independent-groups-do-not-agree' ELSE 'independent-groups-lack-reliability' END AS provisional_reason,
  CASE WHEN nothing THEN 'no-supported-groups' WHEN g < 2 THEN 'insufficient-independent-groups' WHEN near35 = g THEN 'consistent' ELSE 'mixed' END AS consensus_status,
  CASE WHEN nothing THEN 'no-supported-groups' WHEN vp > 0 AND vn > 0 THEN 'mixed-directional-votes' WHEN vp + vn > 0 THEN 'directionally-consistent' ELSE 'directionally-uncertain' END AS vote_status,
  CAST(coalesce(vp, 0) AS INTEGER) AS n_positive, CAST(coalesce(vn, 0) AS INTEGER) AS n_negative,
  array_to_string(list_sort(list_filter([
    CASE WHEN qc THEN 'global-compression-confounder' END, CASE WHEN n_rejected > 0 THEN 'invalid-branch-reliability' END, CASE WHEN nothing THEN 'no-supported-branch' END,
    CASE WHEN vp > 0 AND vn > 0 THEN 'mixed-directional-votes' END, CASE WHEN members > 1 THEN 'correlated-branches-collapsed' END,
    CASE WHEN only_quality THEN 'only-quality-sensitive-evidence' END, CASE WHEN dis >= 0.55 THEN 'independent-evidence-disagrees' END,
    CASE WHEN qso THEN 'quality-sensitive-evidence-only' END, CASE WHEN nfq THEN 'non-face-quality-evidence-only' END,
    CASE WHEN pes IS NOT NULL THEN 'supported-positive-evidence-preserved' END, CASE WHEN abstain AND NOT nothing THEN 'insufficient-independent-evidence' END
  ], lambda x: x IS NOT NULL)), ',') AS reason_codes
FROM f
"""


def _flat(df):
    return df.withColumn("reason_codes", F.array_join("reason_codes", ",")).withColumns({c: F.round(c, 6) for c in ("group_score_p10", "group_score_p90")}).drop("group_scores", "rejected_branches")


def fused(spark, sf_dir):
    return fusion.fuse(branch_results(spark, sf_dir), clips(spark, sf_dir))


@query("WITH " + BRANCH_SQL + " SELECT clip_id, branch, branch_order, status, score, has_confidence, confidence_raw, coverage_raw, observed_raw, fusion_eligible FROM br")
def branch_results_from_events(spark, sf_dir):
    return branch_results(spark, sf_dir)


@query(FUSED_SQL + _SELECT + " WHERE evidence_set = 'all'")
def fusion_all(spark, sf_dir):
    return _flat(fused(spark, sf_dir).where("evidence_set = 'all'"))


@query(FUSED_SQL + _SELECT)
def fusion_sets(spark, sf_dir):
    return _flat(fused(spark, sf_dir))


@query(REP_SQL + """
SELECT clip_id, evidence_set, grp, branch, score, round(rel, 6) AS reliability, members,
       CASE WHEN score >= 0.5 THEN 'positive' WHEN score <= 0.3 THEN 'negative' ELSE 'neutral' END AS direction,
       CASE WHEN score >= 0.5 THEN 1 WHEN score <= 0.3 THEN -1 ELSE 0 END AS vote, rel >= 0.3 AS supported,
       rel * CASE WHEN score >= 0.5 OR score <= 0.3 THEN least(1.0::DOUBLE, abs(score - 0.5::DOUBLE) * 2) ELSE 0 END AS support
FROM rep
""")
def fusion_votes(spark, sf_dir):
    votes = fusion.group_votes(branch_results(spark, sf_dir), clips(spark, sf_dir))
    return votes.drop("weight", "group_weight").withColumn("reliability", F.round("reliability", 6))


@query(REP_SQL + "SELECT clip_id, branch, rejected FROM c1 WHERE rejected IS NOT NULL")
def rejected_branches(spark, sf_dir):
    rows = fused(spark, sf_dir).where("evidence_set = 'all'")
    return rows.select("clip_id", F.explode("rejected_branches").alias("branch", "rejected"))


@query(REP_SQL + "SELECT clip_id, evidence_set, grp, round(score, 6) AS score FROM rep")
def fusion_groups(spark, sf_dir):
    return fused(spark, sf_dir).select("clip_id", "evidence_set", F.explode("group_scores").alias("grp", "score"))
