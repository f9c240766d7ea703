"""Queries of classification and evaluation: a report is a document, its truth the quality label."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.catalogue import query, written
from palisade.operators import evaluate as E
from palisade.plans.fusion import FUSED_SQL, fused
from palisade.plans.standins import clips
from palisade.session import shared_path, table
from palisade.sources import files
from palisade.sources import reports as R

REPORT_SQL = """
rp AS (
  SELECT doc_id AS name,
    CASE WHEN doc_id % 29 <> 0 THEN ((n_chars * 7 + doc_id * 13) % 1000) / 1000.0::DOUBLE END AS score,
    CASE WHEN doc_id % 6 = 0 THEN 'abstain-insufficient-evidence' ELSE 'mixed-anomaly-signal' END AS label,
    CASE WHEN doc_id % 10 <> 9 THEN (doc_id * 17 % 41) / 100.0::DOUBLE END AS group_score_range,
    (doc_id * 7 % 100) / 100.0::DOUBLE AS evidence_coverage, (doc_id * 3 % 50) / 100.0::DOUBLE AS instability_score,
    doc_id % 8 = 3 AS provisional_positive, doc_id % 3 = 0 AS stability_enabled,
    CASE WHEN doc_id % 15 = 0 THEN 'unavailable' WHEN doc_id % 3 = 0 THEN 'ok' END AS stability_status,
    CASE WHEN doc_id % 3 = 0 THEN (doc_id * 11 % 60) / 100.0::DOUBLE END AS score_range,
    doc_id % 9 = 6 AS stable_negative_support, (doc_id % 50) / 100.0::DOUBLE AS stable_negative_score,
    doc_id % 4 = 0 AS provisional_positive_support, doc_id % 5 = 1 AS exploratory_positive_support,
    CAST(doc_id % 3 AS INTEGER) AS feasible_windows, CAST(1 + doc_id % 4 AS INTEGER) AS requested_budgets,
    doc_id % 12 = 0 AS transcode_enabled, CASE WHEN doc_id % 36 = 0 THEN 'unstable' WHEN doc_id % 36 = 12 THEN 'stable' END AS transcode_status,
    (doc_id % 40) / 1000.0::DOUBLE AS cut_rate, CASE WHEN doc_id % 2 = 0 THEN (doc_id * 3 % 40) / 100.0::DOUBLE END AS temporal_score,
    (n_chars % 100) / 100.0::DOUBLE AS face_score, (doc_id * 5 % 40) / 100.0::DOUBLE AS geometry_cv, (doc_id % 9) / 2.0::DOUBLE AS ambiguity,
    CASE WHEN doc_id % 13 <> 0 THEN (doc_id * 7 % 101) / 100.0::DOUBLE END AS detection_rate,
    (doc_id * 19 % 100) / 100.0::DOUBLE AS integrity_score, (doc_id * 23 % 100) / 100.0::DOUBLE AS frequency_score,
    CASE quality WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' END AS expected
  FROM documents LEFT JOIN labels USING (doc_id)
)"""


def reports(spark, sf_dir):
    d = F.col("doc_id")
    part = lambda x, m, by: (x % m) / float(by)
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    n = F.col("n_chars")
    return docs.select(
        d.alias("name"),
        F.when(d % 29 != 0, part(n * 7 + d * 13, 1000, 1000)).alias("score"),
        F.when(d % 6 == 0, "abstain-insufficient-evidence").otherwise("mixed-anomaly-signal").alias("label"),
        F.when(d % 10 != 9, part(d * 17, 41, 100)).alias("group_score_range"),
        part(d * 7, 100, 100).alias("evidence_coverage"), part(d * 3, 50, 100).alias("instability_score"),
        (d % 8 == 3).alias("provisional_positive"), (d % 3 == 0).alias("stability_enabled"),
        F.when(d % 15 == 0, "unavailable").when(d % 3 == 0, "ok").alias("stability_status"),
        F.when(d % 3 == 0, part(d * 11, 60, 100)).alias("score_range"),
        (d % 9 == 6).alias("stable_negative_support"), part(d, 50, 100).alias("stable_negative_score"),
        (d % 4 == 0).alias("provisional_positive_support"), (d % 5 == 1).alias("exploratory_positive_support"),
        (d % 3).cast("int").alias("feasible_windows"), (1 + d % 4).cast("int").alias("requested_budgets"),
        (d % 12 == 0).alias("transcode_enabled"), F.when(d % 36 == 0, "unstable").when(d % 36 == 12, "stable").alias("transcode_status"),
        part(d, 40, 1000).alias("cut_rate"), F.when(d % 2 == 0, part(d * 3, 40, 100)).alias("temporal_score"),
        part(n, 100, 100).alias("face_score"), part(d * 5, 40, 100).alias("geometry_cv"), part(d, 9, 2).alias("ambiguity"),
        F.when(d % 13 != 0, part(d * 7, 101, 100)).alias("detection_rate"),
        part(d * 19, 100, 100).alias("integrity_score"), part(d * 23, 100, 100).alias("frequency_score"),
        F.when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "negative").alias("expected"),
    )


@query("WITH " + REPORT_SQL + " SELECT name, score, expected FROM rp WHERE expected IS NOT NULL AND score BETWEEN 0 AND 1")
def truth_join(spark, sf_dir):
    return reports(spark, sf_dir).where(F.col("expected").isNotNull() & E.valid(F.col("score")).isNotNull()).select("name", "score", "expected")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabeled_reports(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("WITH " + REPORT_SQL + """, q AS (
  SELECT name, cut_rate >= 0.015 AND coalesce(temporal_score, 0) >= 0.18 AS hard, cut_rate >= 0.015 AND coalesce(temporal_score, 0) = 0 AS heavy,
         cut_rate >= 0.025 AND coalesce(temporal_score, 0) = 0 AS severe, rp.* EXCLUDE (name) FROM rp
), s AS (
  SELECT name, CASE WHEN NOT hard AND detection_rate IS NOT NULL AND (
      (face_score >= 0.75 AND geometry_cv >= 0.25 AND detection_rate >= 0.5 AND (NOT severe OR (face_score >= 0.8 AND detection_rate >= 0.8)))
      OR (face_score >= 0.7 AND geometry_cv >= 0.23 AND ambiguity <= 2.5 AND detection_rate <= 0.7 AND NOT severe)
      OR (face_score >= 0.6 AND geometry_cv >= 0.28 AND ambiguity <= 3 AND detection_rate >= 0.85 AND NOT severe)) THEN face_score END AS a,
    CASE WHEN NOT hard AND NOT heavy AND integrity_score >= 0.45 THEN integrity_score END AS b, CASE WHEN NOT hard AND NOT heavy AND frequency_score >= 0.65 THEN frequency_score END AS c
  FROM q
)
SELECT name, coalesce(list_max([a, b, c]), 0) AS directional_score, CAST((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT AS INTEGER) AS n_qualifying,
       CASE WHEN coalesce(list_max([a, b, c]), 0) >= 0.62 THEN 'synthetic' ELSE 'original' END AS directional_label FROM s
""")
def directional_score(spark, sf_dir):
    out = E.directional(reports(spark, sf_dir))
    return out.select("name", "directional_score", "n_qualifying", F.when(F.col("directional_score") >= E.POSITIVE, "synthetic").otherwise("original").alias("directional_label"))


_CLASSIFY = "WITH " + REPORT_SQL + """, x AS (
  SELECT *, (feasible_windows = 1 OR requested_budgets < 3) AS scope,
    stability_enabled AND coalesce(stability_status = 'ok', false) AND (feasible_windows = 1 OR requested_budgets < 3) AND exploratory_positive_support
      AND score_range < 0.35 AND coalesce(group_score_range <= 0.2, true) AS eligible FROM rp
), r AS (
  SELECT *, list_sort(list_filter([
    CASE WHEN label LIKE 'abstain%' THEN 'production-fusion-abstention' END,
    CASE WHEN stability_enabled AND stability_status IS DISTINCT FROM 'ok' THEN 'stability-check-unavailable' END,
    CASE WHEN stability_status = 'ok' AND score_range >= 0.35 AND NOT stable_negative_support THEN 'unstable-window-score' END,
    CASE WHEN stability_status = 'ok' AND stability_enabled AND NOT stable_negative_support AND NOT provisional_positive_support AND NOT ({explore} AND coalesce(eligible, false)) THEN 'window-consensus-not-stable' END,
    CASE WHEN transcode_enabled AND transcode_status = 'unstable' THEN 'unstable-after-transcode' WHEN transcode_enabled AND transcode_status IS DISTINCT FROM 'stable' THEN 'transcode-check-unavailable' END,
    CASE WHEN score IS NULL THEN 'missing-score' END, CASE WHEN group_score_range > 0.2 THEN 'independent-evidence-disagrees' END
  ], lambda v: v IS NOT NULL)) AS reasons FROM x
), k AS (
  SELECT *, CASE WHEN len(reasons) > 0 THEN 'abstain' WHEN score >= {positive} THEN 'threshold-positive' WHEN {provisional} AND provisional_positive THEN 'provisional-positive'
    WHEN {explore} AND eligible THEN 'provisional-positive' WHEN stable_negative_support AND stable_negative_score <= 0.3 THEN 'stable-negative-consensus'
    WHEN score <= 0.3 THEN 'threshold-negative' ELSE 'score-band-abstention' END AS kind FROM r
), c AS (
  SELECT name, expected, score, CASE WHEN kind LIKE '%positive' THEN 'positive' WHEN kind IN ('stable-negative-consensus', 'threshold-negative') THEN 'negative' ELSE 'abstain' END AS predicted,
    kind, CASE WHEN kind = 'score-band-abstention' THEN 'score-between-analysis-thresholds' ELSE array_to_string(reasons, ',') END AS abstain_reasons FROM k
)
"""
_STANDARD = _CLASSIFY.format(explore="false", positive="0.62", provisional="true")


@query(_STANDARD + "SELECT name, predicted, kind AS decision_kind, abstain_reasons FROM c")
def classify_standard(spark, sf_dir):
    out = E.classify(reports(spark, sf_dir))
    return out.select("name", "predicted", "decision_kind", F.array_join("abstain_reasons", ",").alias("abstain_reasons"))


@query(_CLASSIFY.format(explore="true", positive="0.62", provisional="true") + """
SELECT name, predicted, CASE WHEN predicted <> 'abstain' THEN 'exploratory-' || kind ELSE kind END AS decision_kind, abstain_reasons FROM c
""")
def classify_exploratory(spark, sf_dir):
    out = E.classify(reports(spark, sf_dir), explore=True)
    return out.select("name", "predicted", "decision_kind", F.array_join("abstain_reasons", ",").alias("abstain_reasons"))


@query(_STANDARD + """
SELECT name, coalesce(eligible, false) AS eligible, array_to_string(list_sort(list_filter([CASE WHEN NOT scope THEN 'not-a-limited-resource-audit' END,
  CASE WHEN score_range IS NULL THEN 'missing-window-score-range' WHEN score_range >= 0.35 THEN 'window-score-instability' END,
  CASE WHEN group_score_range > 0.2 THEN 'independent-evidence-disagrees' END, CASE WHEN NOT exploratory_positive_support THEN 'insufficient-positive-group-consensus' END
], lambda v: v IS NOT NULL)), ',') AS reasons FROM x
""")
def exploratory_eligibility(spark, sf_dir):
    out = E.exploratory(reports(spark, sf_dir))
    return out.select("name", F.col("exploratory_eligible").alias("eligible"), F.array_join("exploratory_reasons", ",").alias("reasons"))


_RATES = """coalesce(round((tp + fp + tn + fn) / nullif(labeled, 0)::DOUBLE, 6), NULL) AS coverage, round(abstain / nullif(labeled, 0)::DOUBLE, 6) AS abstention_rate,
  round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS sensitivity, round(tn / nullif(tn + fp, 0)::DOUBLE, 6) AS specificity, round(fp / nullif(tn + fp, 0)::DOUBLE, 6) AS false_positive_rate,
  round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round((tp + tn) / nullif(tp + fp + tn + fn, 0)::DOUBLE, 6) AS conditional_accuracy,
  (round(tp / nullif(tp + fn, 0)::DOUBLE, 6) + round(tn / nullif(tn + fp, 0)::DOUBLE, 6)) / 2 AS balanced_accuracy"""
_COUNTS = """count(*) FILTER (WHERE expected = 'positive' AND predicted = 'positive') AS tp, count(*) FILTER (WHERE expected = 'negative' AND predicted = 'positive') AS fp,
  count(*) FILTER (WHERE expected = 'negative' AND predicted = 'negative') AS tn, count(*) FILTER (WHERE expected = 'positive' AND predicted = 'negative') AS fn,
  count(*) FILTER (WHERE predicted = 'abstain') AS abstain, count(*) AS labeled"""


@query(_STANDARD + f", n AS (SELECT {_COUNTS} FROM c WHERE expected IS NOT NULL) SELECT n.*, {_RATES} FROM n")
def confusion_metrics(spark, sf_dir):
    return E.confusion(E.classify(reports(spark, sf_dir)))


_SWEEP = """, ts AS (SELECT DISTINCT t FROM (SELECT unnest(list_transform(range(21), lambda i: i / 20.0::DOUBLE)) AS t UNION ALL SELECT round(score, 6) FROM rp WHERE expected IS NOT NULL AND score IS NOT NULL) WHERE t > 0.3 AND t <= 1),
p AS (
  SELECT t, expected, CASE WHEN len(reasons) > 0 THEN 'abstain' WHEN score >= t THEN 'positive' WHEN {provisional} AND provisional_positive THEN 'positive'
    WHEN stable_negative_support AND stable_negative_score <= 0.3 THEN 'negative' WHEN score <= 0.3 THEN 'negative' ELSE 'abstain' END AS predicted
  FROM r, ts WHERE expected IS NOT NULL
), n AS (SELECT t AS positive_threshold, {counts} FROM p GROUP BY t)
SELECT n.*, {rates} FROM n
"""


@query(_STANDARD + _SWEEP.format(provisional="false", counts=_COUNTS, rates=_RATES))
def operating_points(spark, sf_dir):
    return E.operating_points(reports(spark, sf_dir))


@query(_STANDARD + _SWEEP.format(provisional="true", counts=_COUNTS, rates=_RATES))
def consensus_operating_points(spark, sf_dir):
    return E.operating_points(reports(spark, sf_dir), provisional=True)


@query(_CLASSIFY.format(explore="true", positive="0.62", provisional="true") + _SWEEP.format(provisional="true", counts=_COUNTS, rates=_RATES).replace("THEN 'positive'\n    WHEN stable", "THEN 'positive' WHEN eligible THEN 'positive'\n    WHEN stable"))
def exploratory_operating_points(spark, sf_dir):
    """The sweep with the decisions of audits with few windows or budgets."""
    return E.operating_points(reports(spark, sf_dir), provisional=True, explore=True)


_AP = """SELECT {key} round(avg(hits / k::DOUBLE), 6) AS average_precision FROM (
  SELECT {key} expected, row_number() OVER ({part} ORDER BY score DESC, name) AS k, sum(CASE WHEN expected = 'positive' THEN 1 ELSE 0 END) OVER ({part} ORDER BY score DESC, name) AS hits FROM {of}
) WHERE expected = 'positive' {group}"""


@query("WITH " + REPORT_SQL + """, s AS (SELECT name, expected, score FROM rp WHERE expected IS NOT NULL AND score BETWEEN 0 AND 1),
pr AS (SELECT count(*) AS pairs, count(*) FILTER (WHERE a.score > b.score) AS concordant, count(*) FILTER (WHERE a.score = b.score) AS tied, count(*) FILTER (WHERE a.score < b.score) AS discordant
       FROM s a, s b WHERE a.expected = 'positive' AND b.expected = 'negative')
SELECT (SELECT count(*) FROM s WHERE expected = 'positive') AS positives, (SELECT count(*) FROM s WHERE expected = 'negative') AS negatives, pr.*,
       round((concordant + 0.5::DOUBLE * tied) / pairs, 6) AS auroc, (""" + _AP.format(key="", part="", of="s", group="") + ") AS average_precision FROM pr")
def rank_metrics(spark, sf_dir):
    return E.rank_metrics(reports(spark, sf_dir).select("name", "expected", "score"), [])


@query("WITH " + REPORT_SQL + """, s AS (SELECT * FROM rp WHERE score BETWEEN 0 AND 1)
SELECT a AS positive_median, b AS negative_median, round(a - b, 6) AS gap
FROM (SELECT round(quantile_cont(score, 0.5) FILTER (WHERE expected = 'positive'), 6) AS a, round(quantile_cont(score, 0.5) FILTER (WHERE expected = 'negative'), 6) AS b FROM s)
""")
def class_median_gap(spark, sf_dir):
    return E.class_medians(reports(spark, sf_dir))


_LONG = "WITH " + REPORT_SQL + """, l AS (
  SELECT name, expected, b AS branch, CASE b WHEN 'temporal' THEN temporal_score WHEN 'face' THEN face_score WHEN 'integrity' THEN integrity_score ELSE frequency_score END AS score
  FROM rp, (VALUES ('temporal'), ('face'), ('integrity'), ('frequency')) v(b)
), s AS (SELECT * FROM l WHERE expected IS NOT NULL AND score BETWEEN 0 AND 1)
"""


def long_branches(spark, sf_dir):
    """name, expected, branch, score."""
    pairs = [F.struct(F.lit(b).alias("branch"), F.col(f"{b}_score").alias("score")) for b in ("temporal", "face", "integrity", "frequency")]
    return reports(spark, sf_dir).select("name", "expected", F.inline(F.array(*pairs)))


@query(_LONG + """, pr AS (
  SELECT a.branch, count(*) FILTER (WHERE a.score > b.score) AS concordant, count(*) FILTER (WHERE a.score = b.score) AS tied, count(*) AS pairs
  FROM s a JOIN s b ON a.branch = b.branch AND a.expected = 'positive' AND b.expected = 'negative' GROUP BY a.branch
), ap AS (""" + _AP.format(key="branch,", part="PARTITION BY branch", of="s", group="GROUP BY branch") + """), m AS (
  SELECT branch, count(*) FILTER (WHERE expected = 'positive') AS positives, count(*) FILTER (WHERE expected = 'negative') AS negatives,
    round(quantile_cont(score, 0.5) FILTER (WHERE expected = 'positive'), 6) AS positive_median, round(quantile_cont(score, 0.5) FILTER (WHERE expected = 'negative'), 6) AS negative_median,
    (SELECT count(*) FROM rp WHERE expected IS NOT NULL) - count(*) AS missing_or_invalid FROM s GROUP BY branch
)
SELECT branch, positives, negatives, positive_median, negative_median, round(positive_median - negative_median, 6) AS gap, missing_or_invalid, concordant, tied,
       round((concordant + 0.5::DOUBLE * tied) / pairs, 6) AS auroc, average_precision
FROM m JOIN pr USING (branch) JOIN ap USING (branch)
""")
def branch_diagnostics(spark, sf_dir):
    return E.diagnostics(long_branches(spark, sf_dir))


@query("WITH " + REPORT_SQL + """, s AS (
  SELECT name, round(score, 6) AS score, evidence_coverage * coalesce(1 - group_score_range, 0) * (1 - instability_score) AS c, coalesce(group_score_range > 0.2, false) AS apart FROM rp WHERE score BETWEEN 0 AND 1
)
SELECT name, score, CAST(row_number() OVER (ORDER BY score DESC, name) AS INTEGER) AS rank, round(c, 6) AS confidence, CASE WHEN c < 0.5 OR apart THEN 'low' ELSE 'moderate' END AS confidence_label FROM s
""")
def anomaly_ranking(spark, sf_dir):
    """Every report with a valid score, ranked."""
    return E.ranking(reports(spark, sf_dir)).select("name", "score", F.col("rank").cast("int").alias("rank"), "confidence", "confidence_label")


@query("WITH " + REPORT_SQL + """, s AS (
  SELECT name, round(score, 6) AS score, evidence_coverage * coalesce(1 - group_score_range, 0) * (1 - instability_score) AS c, coalesce(group_score_range > 0.2, false) AS apart FROM rp WHERE score BETWEEN 0 AND 1
)
SELECT name, score, row_number() OVER (ORDER BY score DESC, name) AS rank, round(c, 6) AS confidence, CASE WHEN c < 0.5 OR apart THEN 'low' ELSE 'moderate' END AS confidence_label FROM s
""")
def anomaly_ranking_all(spark, sf_dir):
    """As anomaly_ranking, with ranks as longs."""
    return E.ranking(reports(spark, sf_dir)).select("name", "score", "rank", "confidence", "confidence_label")


@query("WITH " + REPORT_SQL + """, c AS (SELECT count(*) FILTER (WHERE score BETWEEN 0 AND 1) AS ranked_report_count, count(*) AS report_count FROM rp)
SELECT ranked_report_count, report_count, round(ranked_report_count / nullif(report_count, 0)::DOUBLE, 6) AS fraction FROM c
""")
def ranking_coverage(spark, sf_dir):
    """The share of reports that are ranked."""
    return E.ranking_coverage(reports(spark, sf_dir))


@query("WITH " + REPORT_SQL + """, f AS (SELECT name, expected, CASE WHEN score BETWEEN 0 AND 1 THEN CASE WHEN score >= 0.5 THEN 'synthetic' ELSE 'original' END END AS bucket FROM rp)
SELECT count(*) FILTER (WHERE expected = 'positive' AND bucket = 'synthetic') AS true_positive, count(*) FILTER (WHERE expected = 'negative' AND bucket = 'synthetic') AS false_positive,
  count(*) FILTER (WHERE expected = 'negative' AND bucket = 'original') AS true_negative, count(*) FILTER (WHERE expected = 'positive' AND bucket = 'original') AS false_negative,
  count(*) FILTER (WHERE expected IS NULL OR bucket IS NULL) AS unscored FROM f
""")
def forced_bucket(spark, sf_dir):
    rows = reports(spark, sf_dir).withColumn("bucket", E.forced(F.col("score"), 0.5))
    hit = lambda e, b: F.count_if((F.col("expected") == e) & (F.col("bucket") == b))
    return rows.agg(
        hit("positive", "synthetic").alias("true_positive"), hit("negative", "synthetic").alias("false_positive"), hit("negative", "original").alias("true_negative"),
        hit("positive", "original").alias("false_negative"), F.count_if(F.col("expected").isNull() | F.col("bucket").isNull()).alias("unscored"),
    )


_TRUTH = ", tv AS (SELECT clip_id, evidence_set, round(final, 6) AS score, CASE clip_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' END AS expected FROM f)"


def judged_sets(spark, sf_dir):
    """Fused rows of all evidence sets with stand-in labels."""
    k = F.col("clip_id") % 3
    return fused(spark, sf_dir).withColumn("expected", F.when(k == 0, "positive").when(k == 1, "negative"))


@query(FUSED_SQL + _TRUTH + """, fb AS (SELECT *, CASE WHEN score BETWEEN 0 AND 1 THEN score >= 0.5 END AS hi FROM tv),
fc AS (
  SELECT evidence_set, count(*) FILTER (WHERE expected = 'positive' AND hi) AS tp, count(*) FILTER (WHERE expected = 'negative' AND hi) AS fp, count(*) FILTER (WHERE expected = 'negative' AND NOT hi) AS tn,
    count(*) FILTER (WHERE expected = 'positive' AND NOT hi) AS fn, count(*) FILTER (WHERE expected IS NULL OR hi IS NULL) AS unscored, count(expected) AS labeled FROM fb GROUP BY evidence_set
)
SELECT evidence_set, tp AS true_positive, fp AS false_positive, tn AS true_negative, fn AS false_negative, unscored, round((tp + fp + tn + fn) / nullif(labeled, 0)::DOUBLE, 6) AS coverage,
  round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS sensitivity, round(tn / nullif(tn + fp, 0)::DOUBLE, 6) AS specificity FROM fc
""")
def forced_bucket_sets(spark, sf_dir):
    """Forced buckets of each evidence set, with their rates."""
    return E.forced_metrics(judged_sets(spark, sf_dir), 0.5, ["evidence_set"])


@query(FUSED_SQL + _TRUTH + """, ds AS (SELECT clip_id, CASE WHEN clip_id % 4 > 0 THEN (clip_id % 10) / 10.0::DOUBLE END AS score FROM clips)
SELECT clip_id, evidence_set, round(final, 6) AS score, CASE WHEN abstain THEN 'abstain-insufficient-evidence' WHEN final < 0.3 THEN 'low-anomaly-signal' WHEN final < 0.62 THEN 'mixed-anomaly-signal' ELSE 'high-anomaly-signal' END AS label FROM f
UNION ALL SELECT clip_id, 'directional', score, CASE WHEN score IS NOT NULL THEN 'directional-anomaly-score' END FROM ds
""")
def evidence_views(spark, sf_dir):
    """What each report is judged by, under each choice of evidence."""
    rows = fused(spark, sf_dir)
    k = F.col("clip_id")
    directional = clips(spark, sf_dir).select("clip_id", F.when(k % 4 > 0, (k % 10) / 10.0).alias("score"))
    return reduce(DataFrame.unionByName, (E.evidence_view(rows, directional, s) for s in E.EVIDENCE_SETS))


@query()
def evaluation_report(spark, sf_dir):
    """The evaluation as JSON."""
    out = E.audit(reports(spark, sf_dir))
    return out.select(F.to_json(F.struct(*out.columns)).alias("report"))


def _one(name: str) -> str:
    return f"({written(name)})"


@query("SELECT 0.62::DOUBLE AS positive_threshold, 0.3::DOUBLE AS negative_threshold, m.*, k.positives, k.negatives, k.pairs, k.concordant, k.tied, k.discordant, k.auroc, k.average_precision, "
  "g.*, n.provisional_positive_count, n.unlabeled_count FROM " + _one("confusion_metrics") + " m, " + _one("rank_metrics") + " k, " + _one("class_median_gap") + " g, (" + _STANDARD + """
  SELECT count(*) FILTER (WHERE kind = 'provisional-positive') AS provisional_positive_count, count(*) FILTER (WHERE expected IS NULL) AS unlabeled_count FROM c) n
""")
def evaluation_summary(spark, sf_dir):
    """The evaluation's one row, flat."""
    out = E.audit(reports(spark, sf_dir))
    bounds = [F.col(f"thresholds.{b}").alias(f"{b}_threshold") for b in ("positive", "negative")]
    return out.select(*bounds, "metrics.*", "ranking.*", "medians.*", "counts.*")


@query("WITH d AS " + _one("classify_standard") + ", o AS " + _one("operating_points") + ", p AS " + _one("consensus_operating_points") + ", a AS " + _one("anomaly_ranking_all") + ", b AS " + _one("branch_diagnostics") + """
SELECT 'summary' AS section, 1 AS n UNION ALL SELECT 'decisions', count(*) FROM d UNION ALL SELECT 'operating_points', count(*) FROM o
UNION ALL SELECT 'consensus_operating_points', count(*) FROM p UNION ALL SELECT 'ranking', count(*) FROM a UNION ALL SELECT 'branch_diagnostics', count(*) FROM b
""")
def evaluation_sections(spark, sf_dir):
    """The whole evaluation, written as JSON and read again: the rows of each section."""
    path = shared_path(spark, "evaluation")
    tables = E.sections(reports(spark, sf_dir), long_branches(spark, sf_dir))
    tables.pop("exploratory_operating_points")  # has a query of its own
    files.write_evaluation(tables, path)
    return reduce(DataFrame.unionByName, (spark.read.text(f"{path}/{s}").agg(F.lit(s).alias("section"), F.count("*").alias("n")) for s in tables))


#: Reports as JSON text, with fields and branches that some of them lack: what is null is left out. A few are no JSON, and some say
#: numbers in words or as text.
def json_reports(spark, sf_dir):
    r = reports(spark, sf_dir)
    k = F.col("name")
    fields = lambda prefix: {place.removeprefix(prefix): c for c, place, _ in R.FIELDS if place.startswith(prefix)}
    struct = lambda columns: F.struct(*(F.col(c).alias(n) for n, c in columns.items()))
    fusion = F.struct(*(c for c, _ in R.EVIDENCE), F.array(F.concat(F.lit("code-"), (k % 3).cast("string"))).alias("reason_codes"), F.struct(F.when(k % 4 == 1, "mixed-directional-votes").alias("status")).alias("directional_vote_summary"))
    policy = F.struct(F.col("feasible_windows").alias("feasible_window_count"), F.col("requested_budgets").alias("requested_budget_count"))
    stability = {n: c for n, c in fields("stability.").items() if "." not in n}
    face = F.struct(F.col("face_score").cast("string").alias("score"), F.struct("geometry_cv", F.col("ambiguity").alias("median_candidates_per_frame"), "detection_rate").alias("metrics"))
    branches = F.struct(
        F.struct(F.struct("cut_rate").alias("metrics")).alias("scene"), F.when(k % 5 != 0, F.struct(F.col("temporal_score").alias("score"))).alias("temporal"), face.alias("face"),
        F.struct(F.col("integrity_score").alias("score")).alias("integrity"), F.struct(F.col("frequency_score").alias("score")).alias("frequency"),
        F.when(k % 7 == 0, F.struct(F.lit("none").alias("score"))).alias("ghost"),
    )
    whole = F.struct(fusion.alias("fusion"), F.struct(*(F.col(c).alias(n) for n, c in stability.items()), policy.alias("consensus_policy")).alias("stability"), struct(fields("transcode_stability.")).alias("transcode_stability"), branches.alias("branches"))
    text = F.when(k % 31 == 0, "{no report").otherwise(F.to_json(whole))
    return r.select("name", "expected", R.parsed(text).alias("report"))


_READ = REPORT_SQL.replace("FROM documents LEFT JOIN labels USING (doc_id)", "FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id % 31 <> 0")


@query((_STANDARD + "SELECT name, predicted, kind AS decision_kind, abstain_reasons FROM c").replace(REPORT_SQL, _READ) + " UNION ALL SELECT doc_id, 'abstain', 'abstain', 'missing-score' FROM documents WHERE doc_id % 31 = 0")
def json_classified(spark, sf_dir):
    """Decisions on reports of JSON; what is no report has no score and abstains."""
    out = E.classify(R.flat(json_reports(spark, sf_dir)))
    return out.select("name", "predicted", "decision_kind", F.array_join("abstain_reasons", ",").alias("abstain_reasons"))


@query((_LONG + """, u AS (
  SELECT name, expected, branch, CASE WHEN branch = 'temporal' AND name % 5 = 0 THEN NULL ELSE score END AS score FROM l
), v AS (SELECT * FROM u WHERE expected IS NOT NULL AND score BETWEEN 0 AND 1),
pr AS (
  SELECT a.branch, count(*) FILTER (WHERE a.score > b.score) AS concordant, count(*) FILTER (WHERE a.score = b.score) AS tied, count(*) AS pairs
  FROM v a JOIN v b ON a.branch = b.branch AND a.expected = 'positive' AND b.expected = 'negative' GROUP BY a.branch
), ap AS (""" + _AP.format(key="branch,", part="PARTITION BY branch", of="v", group="GROUP BY branch") + """), m AS (
  SELECT branch, count(*) FILTER (WHERE expected = 'positive') AS positives, count(*) FILTER (WHERE expected = 'negative') AS negatives, count(*) AS valid,
    round(quantile_cont(score, 0.5) FILTER (WHERE expected = 'positive'), 6) AS positive_median, round(quantile_cont(score, 0.5) FILTER (WHERE expected = 'negative'), 6) AS negative_median FROM v GROUP BY branch
)
SELECT n.branch, coalesce(positives, 0) AS positives, coalesce(negatives, 0) AS negatives, positive_median, negative_median, round(positive_median - negative_median, 6) AS gap,
       (SELECT count(*) FROM documents JOIN labels USING (doc_id) WHERE quality IN (0, 1)) - coalesce(valid, 0) AS missing_or_invalid, coalesce(concordant, 0) AS concordant, coalesce(tied, 0) AS tied,
       round((concordant + 0.5::DOUBLE * tied) / pairs, 6) AS auroc, average_precision
FROM (VALUES ('scene'), ('temporal'), ('face'), ('integrity'), ('frequency'), ('ghost')) n(branch) LEFT JOIN m USING (branch) LEFT JOIN pr USING (branch) LEFT JOIN ap USING (branch)
""").replace(REPORT_SQL, _READ))
def json_branch_diagnostics(spark, sf_dir):
    """Diagnostics of the branches that reports of JSON happen to name."""
    found = json_reports(spark, sf_dir)
    return E.diagnostics(R.branch_rows(found), found)


@query((_STANDARD + """, s AS (
  SELECT rp.name, round(rp.score, 6) AS score, evidence_coverage * coalesce(1 - group_score_range, 0) * (1 - instability_score) AS f, group_score_range AS g, evidence_coverage AS e, c.abstain_reasons
  FROM rp JOIN c USING (name) WHERE rp.score BETWEEN 0 AND 1
)
SELECT name, score, row_number() OVER (ORDER BY score DESC, name) AS rank, round(f, 6) AS confidence, CASE WHEN f < 0.5 OR g > 0.2 THEN 'low' ELSE 'moderate' END AS confidence_label,
  round(e, 6) AS evidence_coverage, round(g, 6) AS group_score_range, abstain_reasons,
  array_to_string(list_sort(list_filter(['code-' || CAST(name % 3 AS VARCHAR), CASE WHEN g IS NULL THEN 'missing-group-range' WHEN g > 0.2 THEN 'independent-evidence-disagrees' END,
    CASE WHEN e < 0.2 THEN 'insufficient-evidence-coverage' END, CASE WHEN name % 4 = 1 THEN 'mixed-directional-votes' END], lambda v: v IS NOT NULL)), ',') AS reasons FROM s
""").replace(REPORT_SQL, _READ))
def json_ranking(spark, sf_dir):
    """The ranking's rows in full, of reports of JSON."""
    out = E.ranking(E.classify(R.flat(json_reports(spark, sf_dir)))).drop("vote_status")
    return out.withColumns({c: F.array_join(c, ",") for c in ("reasons", "abstain_reasons")})


@query((written("directional_score")).replace(REPORT_SQL, _READ.replace("CASE WHEN doc_id % 2 = 0 THEN (doc_id * 3 % 40) / 100.0::DOUBLE END AS temporal_score", "CASE WHEN doc_id % 2 = 0 AND doc_id % 5 <> 0 THEN (doc_id * 3 % 40) / 100.0::DOUBLE END AS temporal_score"))
  + " UNION ALL SELECT doc_id, 0, 0, 'original' FROM documents WHERE doc_id % 31 = 0")
def json_directional(spark, sf_dir):
    """The directional score of reports of JSON."""
    out = R.flat(json_reports(spark, sf_dir), "directional")
    return out.select("name", F.col("score").alias("directional_score"), "n_qualifying", F.when(F.col("score") >= E.POSITIVE, "synthetic").otherwise("original").alias("directional_label"))
