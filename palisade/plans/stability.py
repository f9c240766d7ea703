"""Queries of stability: windows of a user's events, fused window by window on stand-in group scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.catalogue import query
from palisade.operators import fusion
from palisade.operators import stability as T
from palisade.plans.fusion import FUSED_SQL, fused
from palisade.plans.standins import BRANCH_SQL, SIGNAL_SQL, clips, signals, window_branches

WINDOWS, BUDGETS = [1, 2, 3], [8, 16]

_GRID = """, tc AS (SELECT clip_id, 24.0::DOUBLE AS fps, frame_count, frame_count / 24.0::DOUBLE AS duration_seconds FROM clips),
g0 AS (
  SELECT tc.*, w AS window_seconds, b AS budget, greatest(0.0, (duration_seconds - w) / 2) AS s
  FROM tc, (VALUES (1), (2), (3)) ws(w), (VALUES (8), (16)) bs(b) WHERE duration_seconds + 1e-6 >= w
), g1 AS (SELECT *, least(frame_count - 1, CAST(round_even(s * fps, 0) AS BIGINT)) AS start_frame, least(frame_count - 1, CAST(round_even((s + window_seconds) * fps, 0) AS BIGINT) - 1) AS end_frame FROM g0),
g AS (SELECT clip_id, window_seconds, budget, start_frame, end_frame, least(budget, end_frame - start_frame + 1) AS sample_count FROM g1 WHERE end_frame > start_frame)
"""

_CELLS = "," + SIGNAL_SQL + _GRID + """, wanted AS (
  SELECT DISTINCT clip_id, window_seconds, budget, CASE WHEN i = sample_count - 1 THEN end_frame ELSE CAST(floor(start_frame + i * ((end_frame - start_frame) / (sample_count - 1)::DOUBLE)) AS BIGINT) END AS pos
  FROM (SELECT *, unnest(range(sample_count)) AS i FROM g)
), sm AS (SELECT w.*, value, event_type FROM wanted w JOIN sig USING (clip_id, pos)),
gs AS (
  SELECT clip_id, window_seconds * 1000 + budget AS cell, event_type AS grp, round(quantile_cont(value, 0.5) / (quantile_cont(value, 0.5) + 40), 3) AS score
  FROM sm GROUP BY clip_id, window_seconds, budget, event_type HAVING count(*) >= 2
), ce AS (
  SELECT clip_id, cell, round((max(score) + min(score)) / 2, 4) AS score, round(quantile_cont(score, 0.5), 4) AS stable_score, max(score) - min(score) <= 0.2 AND quantile_cont(score, 0.5) >= 0.3 AS provisional FROM gs GROUP BY clip_id, cell
)
"""


def timed(spark, sf_dir):
    rows = clips(spark, sf_dir).withColumn("fps", F.lit(24.0))
    return rows.withColumn("duration_seconds", F.col("frame_count") / F.col("fps"))


def cells(spark, sf_dir):
    """Group scores and cell scores of all windows and budgets."""
    sampled = T.sampled(T.grid(timed(spark, sf_dir), WINDOWS, BUDGETS), signals(spark, sf_dir).select("clip_id", "pos", "value", "event_type"))
    mid = F.percentile("value", F.lit(0.5))
    cell = (F.col("window_seconds") * 1000 + F.col("budget")).alias("cell")
    groups = sampled.groupBy("clip_id", cell, F.col("event_type").alias("grp")).agg(F.count("*").alias("k"), F.round(mid / (mid + 40), 3).alias("score"))
    groups = groups.where("k >= 2").drop("k")
    m = F.percentile("score", F.lit(0.5))
    scored = groups.groupBy("clip_id", "cell").agg(
        F.round((F.max("score") + F.min("score")) / 2, 4).alias("score"), F.round(m, 4).alias("stable_score"), ((F.max("score") - F.min("score") <= 0.2) & (m >= 0.3)).alias("provisional")
    )
    return scored, groups


@query(FUSED_SQL + _GRID + "SELECT clip_id, CAST(window_seconds AS INTEGER) AS window_seconds, CAST(budget AS INTEGER) AS budget, start_frame, end_frame, sample_count FROM g")
def stability_grid(spark, sf_dir):
    return T.grid(timed(spark, sf_dir), WINDOWS, BUDGETS)


@query(FUSED_SQL + "," + SIGNAL_SQL + _GRID + """
SELECT g.clip_id, CAST(window_seconds AS INTEGER) AS window_seconds, CAST(budget AS INTEGER) AS budget, count(s.pos) AS cuts, min(s.pos) AS first_cut, max(s.pos) AS last_cut
FROM g LEFT JOIN (SELECT clip_id, pos FROM sig WHERE event_type = 'error') s ON s.clip_id = g.clip_id AND s.pos BETWEEN start_frame AND end_frame GROUP BY g.clip_id, window_seconds, budget
""")
def window_cuts(spark, sf_dir):
    """The cuts (here: errors) within each window."""
    cuts = signals(spark, sf_dir).where("event_type = 'error'").select("clip_id", F.col("pos").cast("long").alias("cut"))
    found = T.cuts_within(T.grid(timed(spark, sf_dir), WINDOWS, BUDGETS), cuts)
    return found.groupBy("clip_id", "window_seconds", "budget").agg(F.count("cut").alias("cuts"), F.min("cut").alias("first_cut"), F.max("cut").alias("last_cut"))


@query(FUSED_SQL + _CELLS + "SELECT clip_id, cell, grp, score FROM gs")
def stability_cells(spark, sf_dir):
    return cells(spark, sf_dir)[1]


_DECISION = FUSED_SQL + _CELLS + """, n AS (SELECT clip_id, count(*) AS n, ceil(count(*) * 0.6::DOUBLE) AS req, round(ceil(count(*) * 0.6::DOUBLE) / count(*), 6) AS rf FROM ce GROUP BY clip_id),
gm AS (SELECT clip_id, grp, count(*) AS samples, quantile_cont(score, 0.5) AS mid, max(score) - min(score) AS spread FROM gs GROUP BY clip_id, grp),
gd AS (SELECT clip_id, grp, quantile_cont(abs(score - mid), 0.5) AS mad FROM gs JOIN gm USING (clip_id, grp) GROUP BY clip_id, grp),
st AS (SELECT gm.*, mad, n, samples / n::DOUBLE AS support, samples >= req AND samples / n::DOUBLE >= rf AND spread <= 0.2 AS stable FROM gm JOIN gd USING (clip_id, grp) JOIN n USING (clip_id)),
sl AS (
  SELECT clip_id, count(*) FILTER (WHERE stable AND mid <= 0.3) AS ng, count(*) FILTER (WHERE stable AND mid >= 0.5) AS pg,
         quantile_cont(round(mid, 6), 0.5) FILTER (WHERE stable AND mid <= 0.3) AS ns, quantile_cont(round(mid, 6), 0.5) FILTER (WHERE stable AND mid >= 0.5) AS ps FROM st GROUP BY clip_id
), cw AS (
  SELECT clip_id, count(*) FILTER (WHERE m <= 0.3 AND r <= 0.2) AS nc, count(*) FILTER (WHERE m >= 0.5 AND r <= 0.2) AS pc
  FROM (SELECT clip_id, cell, quantile_cont(score, 0.5) AS m, max(score) - min(score) AS r FROM gs GROUP BY clip_id, cell HAVING count(*) >= 2) GROUP BY clip_id
), cs AS (SELECT clip_id, quantile_cont(score, 0.5) AS med, max(score) - min(score) AS rng, count(*) FILTER (WHERE provisional) AS k, quantile_cont(stable_score, 0.5) FILTER (WHERE provisional) AS km FROM ce GROUP BY clip_id),
cm AS (SELECT clip_id, quantile_cont(abs(score - med), 0.5) AS mad FROM ce JOIN cs USING (clip_id) GROUP BY clip_id),
d0 AS (
  SELECT n.clip_id, n, req, med, mad, rng, k, km, coalesce(ng, 0) AS ng, coalesce(pg, 0) AS pg, coalesce(nc, 0) AS nc, coalesce(pc, 0) AS pc, ns, ps,
         coalesce(ng >= 2 AND nc >= req AND nc / n::DOUBLE >= rf AND ns <= 0.3, false) AS neg, coalesce(pg >= 2 AND pc >= req AND pc / n::DOUBLE >= rf AND ps >= 0.5, false) AS gp, k >= req AND k / n::DOUBLE >= rf AS kk
  FROM n JOIN cs USING (clip_id) JOIN cm USING (clip_id) LEFT JOIN sl USING (clip_id) LEFT JOIN cw USING (clip_id)
), d AS (SELECT *, gp AND rng < 0.35 AS ex, gp AND kk AND rng < 0.35 AS pos FROM d0)
"""


@query(_DECISION + """
SELECT clip_id, grp, samples, round(support, 6) AS support, round(mid, 6) AS mid, round(mad, 6) AS mad, round(spread, 6) AS spread, stable, stable AND mid <= 0.3 AS negative, stable AND mid >= 0.5 AS positive FROM st
""")
def stability_groups(spark, sf_dir):
    scored, groups = cells(spark, sf_dir)
    n = scored.groupBy("clip_id").agg(F.count("*").alias("n"))
    return T.group_stability(groups, n.withColumns(T.quorum(F.col("n"), F.lit(len(WINDOWS)), F.lit(len(BUDGETS)))))


@query(_DECISION + """
SELECT clip_id, n, CAST(req AS INTEGER) AS required_count, round(med, 6) AS score_median, round(mad, 6) AS score_mad, round(rng, 6) AS score_range, round(greatest(0.0, 1 - least(1.0, rng / 0.5)), 6) AS stability_index,
  k AS consensus_count, round(km, 6) AS consensus_median, ng AS negative_groups, pg AS positive_groups, nc AS negative_count, pc AS positive_count, round(ns, 6) AS stable_negative_score,
  round(ps, 6) AS stable_positive_score, neg AS stable_negative_support, ex AS exploratory_positive_support, pos AS provisional_positive_support,
  CASE WHEN neg THEN 'stable-low-independent-group-consensus' WHEN pos THEN 'stable-positive-independent-group-consensus' WHEN rng >= 0.35 THEN 'window-scores-unstable' ELSE 'insufficient-window-consensus' END AS decision_reason
FROM d
""")
def stability_decision(spark, sf_dir):
    return T.decision(*cells(spark, sf_dir), len(WINDOWS), len(BUDGETS))


#: SQL of windows, each fused as a clip is: a window's clip_id is clip_id * 10000 + cell.
_WINDOWS = ("WITH " + BRANCH_SQL + "," + SIGNAL_SQL).replace("), br AS (", "), br0 AS (").replace("), clips AS (", "), whole AS (") + _GRID.replace("FROM clips)", "FROM whole)") + """, wanted AS (
  SELECT DISTINCT clip_id, window_seconds * 1000 + budget AS cell, CASE WHEN i = sample_count - 1 THEN end_frame ELSE CAST(floor(start_frame + i * ((end_frame - start_frame) / (sample_count - 1)::DOUBLE)) AS BIGINT) END AS pos
  FROM (SELECT *, unnest(range(sample_count)) AS i FROM g)
), br AS (
  SELECT wanted.clip_id * 10000 + cell AS clip_id, branch, branch_order, CASE WHEN count(*) >= 2 THEN 'ok' ELSE 'unavailable' END AS status,
         round(quantile_cont(value, 0.5) / (quantile_cont(value, 0.9) + 0.000001), 3) AS score, any_value(wanted.clip_id % 11 <> branch_order) AS has_confidence,
         any_value(CASE WHEN wanted.clip_id % 13 = branch_order THEN 'bad' WHEN wanted.clip_id % 17 = branch_order THEN NULL ELSE '' END) AS odd, CAST(round(least(1.0, count(*) / 8.0::DOUBLE), 6) AS VARCHAR) AS plain,
         CASE odd WHEN 'bad' THEN 'bad' WHEN '' THEN plain END AS confidence_raw, any_value(CASE WHEN wanted.clip_id % 19 = branch_order THEN 'x' ELSE '1.0' END) AS coverage_raw,
         CASE WHEN any_value(wanted.clip_id) % 3 = 0 THEN CAST(count(*) AS VARCHAR) END AS observed_raw, any_value(NOT (wanted.clip_id % 23 = branch_order)) AS fusion_eligible
  FROM wanted JOIN sig USING (clip_id, pos) JOIN dim ON dim.event_type = sig.event_type AND dim.half = hour(ts) % 2 GROUP BY wanted.clip_id, cell, branch, branch_order
), clips AS (SELECT DISTINCT whole.clip_id * 10000 + window_seconds * 1000 + budget AS clip_id, quality_confounder, detection_frames FROM g JOIN whole USING (clip_id))
""" + FUSED_SQL.removeprefix("WITH " + BRANCH_SQL)


def windows(spark, sf_dir):
    """Each window of each budget, fused from its own sample."""
    cell = (F.col("window_seconds") * 1000 + F.col("budget")).cast("long").alias("cell")
    grid = T.grid(timed(spark, sf_dir), WINDOWS, BUDGETS)
    sampled = T.sampled(grid, signals(spark, sf_dir)).withColumn("cell", F.col("window_seconds") * 1000 + F.col("budget"))
    of = clips(spark, sf_dir).select("clip_id", "quality_confounder", "detection_frames")
    return fusion.fuse(window_branches(spark, sampled), grid.select("clip_id", cell).join(of, "clip_id"), ("clip_id", "cell"))


@query(_WINDOWS + """
SELECT CAST(floor(clip_id / 10000) AS BIGINT) AS clip_id, CAST(clip_id % 10000 AS BIGINT) AS cell, evidence_set,
  CASE WHEN abstain THEN 'abstain-insufficient-evidence' WHEN final < 0.3 THEN 'low-anomaly-signal' WHEN final < 0.62 THEN 'mixed-anomaly-signal' ELSE 'high-anomaly-signal' END AS label,
  round(round(final, 6), 4) AS score, CASE WHEN nothing THEN 0 ELSE round(least(1.0, cov), 6) END AS evidence_coverage, round(mid, 6) AS stable_anomaly_score, coalesce(prov, false) AS provisional_positive FROM f
""")
def window_fusion(spark, sf_dir):
    return windows(spark, sf_dir).select("clip_id", "cell", "evidence_set", "label", F.round("score", 4).alias("score"), "evidence_coverage", "stable_anomaly_score", "provisional_positive")


@query(_WINDOWS + """, gs AS (SELECT CAST(floor(clip_id / 10000) AS BIGINT) AS clip_id, clip_id % 10000 AS cell, grp, round(score, 6) AS score FROM rep WHERE evidence_set = 'all'),
ce AS (SELECT CAST(floor(clip_id / 10000) AS BIGINT) AS clip_id, clip_id % 10000 AS cell, round(final, 6) AS score, round(mid, 6) AS stable_score, prov AS provisional FROM f WHERE evidence_set = 'all' AND NOT nothing)
""" + _DECISION.removeprefix(FUSED_SQL + _CELLS) + """
SELECT clip_id, n, round(round(med, 6), 4) AS score_median, round(round(rng, 6), 4) AS score_range, k AS consensus_count, ng AS negative_groups, pg AS positive_groups, neg AS stable_negative_support, pos AS provisional_positive_support FROM d
""")
def window_decision(spark, sf_dir):
    """The decision over windows from their own fused scores and groups."""
    rows = windows(spark, sf_dir).where("evidence_set = 'all' AND score IS NOT NULL")
    scored = rows.select("clip_id", "cell", "score", F.col("stable_anomaly_score").alias("stable_score"), F.col("provisional_positive").alias("provisional"))
    groups = rows.select("clip_id", "cell", F.explode("group_scores").alias("grp", "score"))
    out = T.decision(scored, groups, len(WINDOWS), len(BUDGETS))
    return out.select("clip_id", "n", F.round("score_median", 4).alias("score_median"), F.round("score_range", 4).alias("score_range"), "consensus_count", "negative_groups", "positive_groups", "stable_negative_support", "provisional_positive_support")


_LABEL = "CASE WHEN abstain THEN 'abstain-insufficient-evidence' WHEN final < 0.3 THEN 'low-anomaly-signal' WHEN final < 0.62 THEN 'mixed-anomaly-signal' ELSE 'high-anomaly-signal' END"


@query(_DECISION + """
SELECT f.clip_id, prov IS NOT NULL AND prov AND coalesce(pos, true) AS provisional_positive,
  CASE WHEN prov AND pos IS NOT NULL THEN CASE WHEN pos THEN 'independent-groups-and-windows-stable-consensus' ELSE 'window-consensus-not-stable' END ELSE 'as-fused' END AS reason,
  coalesce(neg, false) AS noted FROM f LEFT JOIN d ON d.clip_id = f.clip_id WHERE evidence_set = 'all'
""")
def stability_consensus(spark, sf_dir):
    before = fused(spark, sf_dir).where("evidence_set = 'all'")
    after = T.apply_consensus(before, stability_decision(spark, sf_dir))
    changed = F.col("provisional_reason").isin("window-consensus-not-stable", "independent-groups-and-windows-stable-consensus")
    return after.select("clip_id", "provisional_positive", F.when(changed, F.col("provisional_reason")).otherwise("as-fused").alias("reason"), F.array_contains("reason_codes", "stable-negative-evidence").alias("noted"))


_TRANSCODE = """, tr AS (SELECT clip_id, round(final, 6) AS a, CASE WHEN clip_id % 3 <> 2 THEN round(round(final, 6) * CASE WHEN clip_id % 3 = 0 THEN 0.9::DOUBLE ELSE 0.4::DOUBLE END, 6) END AS b FROM f WHERE evidence_set = 'all'),
td AS (SELECT clip_id, abs(a - b) AS delta, CASE WHEN a - b IS NULL THEN 'unavailable' WHEN abs(a - b) < 0.2 THEN 'stable' ELSE 'unstable' END AS ts FROM tr)
"""


def _transcoded(spark, sf_dir):
    before = fused(spark, sf_dir).where("evidence_set = 'all'")
    k = F.col("clip_id") % 3
    after = before.select("clip_id", F.when(k != 2, F.round(F.col("score") * F.when(k == 0, 0.9).otherwise(0.4), 6)).alias("score"))
    return before, T.transcode_check(before, after)


@query(FUSED_SQL + _TRANSCODE + "SELECT clip_id, round(delta, 6) AS score_delta, ts AS transcode_status FROM td")
def transcode_delta(spark, sf_dir):
    return _transcoded(spark, sf_dir)[1]


@query(_DECISION + _TRANSCODE + """
SELECT f.clip_id, CASE WHEN (coalesce(rng >= 0.35, false) OR ts = 'unstable') AND NOT (coalesce(neg, false) AND ts <> 'unstable') AND NOT abstain THEN 'abstain-unstable-evidence' ELSE """ + _LABEL + """ END AS label,
  coalesce(rng >= 0.35, false) AND NOT (coalesce(neg, false) AND ts <> 'unstable') AS by_windows, ts = 'unstable' AS by_transcode
FROM f LEFT JOIN d ON d.clip_id = f.clip_id LEFT JOIN td ON td.clip_id = f.clip_id WHERE evidence_set = 'all'
""")
def robustness_abstention(spark, sf_dir):
    before, check = _transcoded(spark, sf_dir)
    after = T.robustness_abstention(before, stability_decision(spark, sf_dir), check.select("clip_id", "transcode_status"))
    has = lambda r: F.array_contains("reason_codes", r)
    return after.select("clip_id", "label", has("stability-instability").alias("by_windows"), has("transcode-instability").alias("by_transcode"))
