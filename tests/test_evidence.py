"""Fusion, localization, stability, classification and projections on hand-made evidence."""

import pytest
from pyspark.sql import functions as F

from palisade.operators import branches as B
from palisade.operators import evaluate as E
from palisade.operators import fusion, localize, project, stability
from palisade.sources import adapters, files

BRANCH = "clip_id long, branch string, branch_order int, status string, score double, has_confidence boolean, confidence_raw string, coverage_raw string, observed_raw string, fusion_eligible boolean"


def fused(spark, branches, confounded=False, faces=None, which="all"):
    """branches: name -> score, or a dict of fields."""
    rows = []
    for k, (name, v) in enumerate(branches.items()):
        v = v if isinstance(v, dict) else {"score": v}
        rows.append((1, name, k, v.get("status", "ok"), v.get("score"), "confidence" in v or "raw" not in v, str(v.get("confidence", 1.0)) if v.get("confidence", 1.0) is not None else None, v.get("coverage"), v.get("observed"), v.get("eligible")))
    b = spark.createDataFrame(rows, BRANCH)
    clips = spark.createDataFrame([(1, confounded, faces)], "clip_id long, quality_confounder boolean, detection_frames double")
    return fusion.fuse(b, clips).where(F.col("evidence_set") == which).first()


def test_one_branch_is_not_enough(spark):
    r = fused(spark, {"temporal": 0.9})
    assert r.label == "abstain-insufficient-evidence" and r.provisional_reason == "fewer-than-two-independent-groups"


def test_no_evidence(spark):
    r = fused(spark, {"temporal": {"score": None}, "scene": 0.9, "face": {"score": 0.5, "status": "unavailable"}})
    assert r.score is None and r.group_count == 0 and r.reason_codes == ["no-supported-branch"] and r.evidence_coverage == 0


def test_malformed_fields_are_told_apart(spark):
    r = fused(spark, {
        "temporal": {"score": 0.7, "confidence": "nan"}, "face": {"score": 0.7, "coverage": "text"}, "audio": {"score": 0.7, "observed": "many"},
        "frequency": {"score": 0.7, "confidence": None}, "wavelet": {"score": 0.7, "observed": "-1"}, "periodicity": 0.7,
    })
    assert r.rejected_branches == {"temporal": "invalid-confidence", "face": "invalid-coverage", "audio": "invalid-observation-count", "wavelet": "invalid-observation-count"}
    assert "invalid-branch-reliability" in r.reason_codes and r.group_count == 1


def test_missing_confidence_is_half(spark):
    both = fused(spark, {"temporal": {"score": 0.7, "raw": 1}, "face": 0.7})
    assert both.evidence_coverage == pytest.approx((1.25 * 0.5 + 0.7) / 1.95, abs=1e-6)


def test_contradiction_abstains(spark):
    r = fused(spark, {"temporal": 0.95, "face": 0.05})
    assert r.label.startswith("abstain") and "independent-evidence-disagrees" in r.reason_codes and r.vote_status == "mixed-directional-votes"


def test_consistent_evidence_is_provisional(spark):
    r = fused(spark, {"temporal": 0.72, "face": 0.80})
    assert r.provisional_positive and r.label == "high-anomaly-signal" and r.consensus_status == "consistent"


def test_positive_evidence_is_kept_from_dilution(spark):
    r = fused(spark, {"temporal": 0.95, "face": 0.90, "audio": {"score": 0.3, "confidence": 0.2}})
    assert r.positive_evidence_score > 0.9 and r.score == r.positive_evidence_score


def test_codec_alone_under_compression(spark):
    r = fused(spark, {"recompression": 0.9, "frequency": 0.8}, confounded=True)
    assert r.label.startswith("abstain") and {"only-quality-sensitive-evidence", "quality-sensitive-evidence-only", "correlated-branches-collapsed"} <= set(r.reason_codes)
    r = fused(spark, {"recompression": {"score": 0.9}, "wavelet": 0.9, "temporal": 0.1}, confounded=True, faces=0.0)
    assert "non-face-quality-evidence-only" in r.reason_codes


def test_ties_go_to_the_first_branch(spark):
    rows = [(1, b, k, "ok", 0.5, True, "1.0", None, None, None) for k, b in enumerate(("spatial", "face"))]
    clips = spark.createDataFrame([(1, False, None)], "clip_id long, quality_confounder boolean, detection_frames double")
    rows = spark.createDataFrame([(*r[:4], 0.56 / (0.8 if r[1] == "spatial" else 0.7), *r[5:]) for r in rows], BRANCH)
    assert fusion.group_votes(rows, clips).where("evidence_set = 'all'").first().members == 2


def test_sets_are_fused_apart(spark):
    scores = {"temporal": 0.7, "face": 0.75, "periodicity": 0.1, "wavelet": 0.15}
    assert fused(spark, scores, which="legacy").score > 0.7 and fused(spark, scores, which="new_additions").score < 0.2


def test_event_clusters(spark):
    rows = [(1, "wavelet", "instability_indices", [10, 40]), (1, "scene", "cut_indices", [11]), (1, "codec", "keyframe_indices", [41]), (2, "face", "observation_indices", [5, None])]
    m = spark.createDataFrame(rows, "clip_id long, branch string, metric string, indices array<long>")
    clips = spark.createDataFrame([(1, 10.0, 30.0), (2, None, None), (3, 10.0, 1.0)], "clip_id long, fps double, duration_seconds double")
    ev = localize.events(m, clips)
    found = sorted((r.start_frame, r.end_frame, r.branch_count) for r in localize.clusters(ev).where("clip_id = 1").collect())
    assert found == [(10, 11, 2), (40, 40, 1)]
    a = {r.clip_id: r for r in localize.alignment(ev, clips).collect()}
    assert a[1].status == "cross-branch-supported" and a[1].score == pytest.approx(round(2 / 3 * 0.5, 6)) and a[3].status == "no-localized-events" and a[3].score is None
    bins = {(r.clip_id, r.bucket): r for r in localize.bins(ev, clips).collect()}
    assert set(bins) == {(1, 0), (1, 1)} and bins[1, 0].end_seconds == 2.5
    assert {r.clip_id: r.ts for r in ev.where("clip_id = 2").collect()} == {2: None}


def test_grid(spark):
    clips = spark.createDataFrame([(1, 10.0, 100, 10.0), (2, 10.0, 15, 1.5), (3, 0.0, 100, 10.0)], "clip_id long, fps double, frame_count long, duration_seconds double")
    rows = {(r.clip_id, r.window_seconds, r.budget): r for r in stability.grid(clips, [1, 5, 20, 1], [2, 8]).collect()}
    assert set(rows) == {(1, 1, 4), (1, 1, 8), (1, 5, 4), (1, 5, 8), (2, 1, 4), (2, 1, 8)}
    assert (rows[1, 5, 4].start_frame, rows[1, 5, 4].end_frame) == (25, 74)
    frames = spark.range(100).select(F.lit(1).cast("long").alias("clip_id"), F.col("id").alias("pos"))
    got = [r.pos for r in stability.sampled(stability.grid(clips, [5], [4]), frames).orderBy("pos").collect()]
    assert got == [25, 41, 57, 74]


def decide(spark, table):
    """table: cell -> group -> score."""
    groups = spark.createDataFrame([(1, c, g, s) for c, gs in table.items() for g, s in gs.items()], "clip_id long, cell int, grp string, score double")
    cells = groups.groupBy("clip_id", "cell").agg(F.avg("score").alias("score"), F.median("score").alias("stable_score"), (F.median("score") >= 0.5).alias("provisional"))
    return stability.decision(cells, groups, len(table), 3).first()


def test_stability(spark):
    low = decide(spark, {k: {"motion": 0.18, "spatial": 0.20} for k in range(4)})
    assert low.stable_negative_support and low.decision_reason == "stable-low-independent-group-consensus" and low.score_range == 0
    high = decide(spark, {k: {"motion": 0.72, "spatial": 0.76} for k in range(4)})
    assert high.provisional_positive_support and high.exploratory_positive_support and high.stable_positive_score == 0.74
    torn = decide(spark, {k: {"motion": 0.95, "spatial": 0.05} for k in range(4)})
    assert not torn.stable_negative_support and not torn.provisional_positive_support
    one = decide(spark, {0: {"motion": 0.72, "spatial": 0.76}})
    assert one.required_count == 1 and one.provisional_positive_support
    wide = decide(spark, {0: {"motion": 0.1, "spatial": 0.1}, 1: {"motion": 0.9, "spatial": 0.9}})
    assert wide.decision_reason == "window-scores-unstable"


REPORT = """name string, score double, label string, group_score_range double, evidence_coverage double, instability_score double, provisional_positive boolean, stability_enabled boolean,
  stability_status string, score_range double, stable_negative_support boolean, stable_negative_score double, provisional_positive_support boolean, exploratory_positive_support boolean,
  feasible_windows int, requested_budgets int, transcode_enabled boolean, transcode_status string, expected string"""


def reports(spark, *rows):
    names = [part.split()[0] for part in REPORT.split(",")]
    base = {"label": "mixed-anomaly-signal"}
    return spark.createDataFrame([tuple({**base, "name": str(k), **r}.get(n) for n in names) for k, r in enumerate(rows)], REPORT)


@pytest.mark.parametrize("report, predicted, kind", [
    ({"score": 0.7}, "positive", "threshold-positive"),
    ({"score": 0.2}, "negative", "threshold-negative"),
    ({"score": 0.45}, "abstain", "score-band-abstention"),
    ({"score": 0.45, "provisional_positive": True}, "positive", "provisional-positive"),
    ({"score": 0.9, "label": "abstain-insufficient-evidence"}, "abstain", "abstain"),
    ({"score": 0.9, "group_score_range": 0.21}, "abstain", "abstain"),
    ({"score": 0.9, "transcode_enabled": True, "transcode_status": "unstable"}, "abstain", "abstain"),
    ({"score": 0.9, "stability_enabled": True, "stability_status": "unavailable"}, "abstain", "abstain"),
    ({"score": 0.9, "stability_enabled": True, "stability_status": "ok", "score_range": 0.1}, "abstain", "abstain"),
    ({"score": 0.45, "stability_enabled": True, "stability_status": "ok", "score_range": 0.5, "stable_negative_support": True, "stable_negative_score": 0.2}, "negative", "stable-negative-consensus"),
    ({"score": None}, "abstain", "abstain"),
    ({"score": 1.5}, "abstain", "abstain"),
])
def test_classify(spark, report, predicted, kind):
    r = E.classify(reports(spark, report)).first()
    assert (r.predicted, r.decision_kind) == (predicted, kind)


def test_exploratory(spark):
    row = {"score": 0.5, "stability_enabled": True, "stability_status": "ok", "score_range": 0.1, "exploratory_positive_support": True, "feasible_windows": 1, "requested_budgets": 3}
    assert E.classify(reports(spark, row), explore=True).first().decision_kind == "exploratory-provisional-positive"
    assert E.classify(reports(spark, row)).first().predicted == "abstain"
    full = E.exploratory(reports(spark, {**row, "feasible_windows": 3})).first()
    assert not full.exploratory_eligible and full.exploratory_reasons == ["not-a-limited-resource-audit"]


def test_thresholds_are_checked(spark):
    with pytest.raises(ValueError):
        E.classify(reports(spark, {"score": 0.5}), 0.2, 0.3)


def test_rank_metrics_two_ways(spark):
    import random

    rng = random.Random(4)
    rows = [(str(k), rng.choice(["positive", "negative", None]), rng.choice([None, 1.2, *(x / 10 for x in range(11))])) for k in range(200)]
    df = spark.createDataFrame(rows, "name string, expected string, score double")
    r = E.rank_metrics(df, []).first()
    good = [x for x in rows if x[1] and x[2] is not None and x[2] <= 1]
    pos, neg = ([x[2] for x in good if x[1] == e] for e in ("positive", "negative"))
    c, t = sum(a > b for a in pos for b in neg), sum(a == b for a in pos for b in neg)
    assert (r.concordant, r.tied, r.pairs) == (c, t, len(pos) * len(neg)) and r.auroc == round((c + t / 2) / len(pos) / len(neg), 6)
    other = E.rank_metrics(df.withColumn("expected", F.when(F.col("expected") == "positive", "negative").when(F.col("expected") == "negative", "positive")), []).first()
    assert other.auroc == pytest.approx(1 - r.auroc, abs=2e-6)


def test_sweep_is_the_classifier_at_each_threshold(spark):
    import random

    rng = random.Random(7)
    rows = [{"score": rng.choice([None, *(x / 50 for x in range(51))]), "expected": rng.choice(["positive", "negative", None]), "provisional_positive": rng.random() < 0.3, "group_score_range": rng.choice([0.1, 0.3]),
             "stable_negative_support": rng.random() < 0.2, "stable_negative_score": 0.2} for _ in range(120)]
    df = reports(spark, *rows)
    for provisional in (False, True):
        points = {r.positive_threshold: r for r in E.operating_points(df, provisional=provisional).collect()}
        for t in (0.35, 0.5, 0.62, 1.0):
            if t in points:
                one = E.confusion(E.classify(df, t, provisional=provisional)).first()
                assert all(points[t][c] == one[c] for c in ("tp", "fp", "tn", "fn", "abstain", "labeled", "balanced_accuracy"))


@pytest.mark.parametrize("values, score", [
    ((0.0, None, 0.76, 0.26, 2.0, 0.6, 0.2, 0.2), 0.76), ((0.02, 0.2, 0.9, 0.3, 2.0, 0.6, 0.9, 0.9), 0.0), ((0.02, None, 0.1, 0.1, 2.0, 0.6, 0.9, 0.9), 0.0),
    ((0.03, None, 0.85, 0.3, 2.0, 0.85, 0.9, 0.9), 0.85), ((0.03, None, 0.78, 0.3, 2.0, 0.6, 0.2, 0.2), 0.0), ((0.0, 0.1, 0.62, 0.29, 2.9, 0.9, 0.2, 0.2), 0.62), ((0.0, 0.1, None, None, None, None, 0.5, 0.7), 0.7),
])
def test_directional(spark, values, score):
    names = "cut_rate temporal_score face_score geometry_cv ambiguity detection_rate integrity_score frequency_score".split()
    df = spark.createDataFrame([values], ", ".join(f"{n} double" for n in names))
    r = E.directional(df).first()
    assert r.directional_score == score and (r.n_qualifying > 0) == (score > 0)


def test_router_gate(spark):
    maps = [{"a": 0.74, "b": 0.26}, {"a": 0.69, "b": 0.31}, {"a": 0.9}, {}, {"a": 0.8, "b": 0.7}, {"a": 2.0, "b": 0.8}, None]
    df = spark.createDataFrame([(k, m) for k, m in enumerate(maps)], "k int, p map<string,double>")
    got = [r.x and (r.x.status, r.x.label) for r in df.select("k", project.router_gate(F.col("p")).alias("x")).orderBy("k").collect()]
    assert got == [("classified", "a"), ("abstain", "unknown"), ("classified", "a"), None, ("abstain", "unknown"), ("classified", "b"), None]


def test_reconcile(spark):
    f = spark.createDataFrame([(1, "high-anomaly-signal", 0.8), (2, "high-anomaly-signal", 0.8), (3, "abstain-insufficient-evidence", 0.9), (4, "mixed-anomaly-signal", 0.5)], "clip_id long, label string, score double")
    r = spark.createDataFrame([(1, "binary", "classified", "synthetic"), (2, "binary", "classified", "original"), (3, "binary", "classified", "synthetic"), (4, "specialist", "classified", "sports")], "clip_id long, source string, status string, label string")
    got = {x.clip_id: (x.status, x.decision) for x in project.reconcile(f, r).collect()}
    assert got == {1: ("agreed", "synthetic"), 2: ("conflict", "review"), 3: ("inconclusive", "review"), 4: ("inconclusive", "review")}


def test_reconcile_goes_by_the_label_where_the_rounded_score_crosses_its_bound(spark):
    """A fused score of 0.6199999 is mixed, and 0.62 once it is rounded; without a label of fusion the score decides."""
    f = spark.createDataFrame([(1, "mixed-anomaly-signal", 0.62), (2, "mixed-anomaly-signal", 0.62), (3, None, 0.62), (4, "low-anomaly-signal", 0.3)], "clip_id long, label string, score double")
    r = spark.createDataFrame([(1, "binary", "classified", "original"), (2, "binary", "classified", "synthetic"), (4, "binary", "classified", "original")], "clip_id long, source string, status string, label string")
    out = project.reconcile(f, r)
    assert {x.clip_id: (x.status, x.decision) for x in out.collect()} == {1: ("inconclusive", "review"), 2: ("inconclusive", "review"), 3: ("agreed", "synthetic"), 4: ("agreed", "original")}


def test_branches_on_synthetic_clips(spark):
    from palisade.functions import tiles as T

    def signature(kind):
        clip = files.synthetic_clip(spark, width=48, height=32, kind=kind)
        return clip.select(F.lit(1).cast("long").alias("clip_id"), F.col("frame_index").alias("pos"), "frame_index", T.block_means(F.col("pixels"), 48, 8, 12).alias("signature"))

    burst = B.periodicity(signature("duplicate-burst")).first()
    assert burst.longest_run >= 7 and burst.score is not None
    assert B.periodicity(signature("plain")).first().score is None
    blended, sharp = (B.resampling(signature(k)).first() for k in ("interpolation", "plain"))
    assert blended.score is None and blended.fusion_eligible is False and blended.diagnostic_score > sharp.diagnostic_score
    again = B.periodicity(signature("duplicate-burst").repartition(5)).first()
    assert again == burst


def test_audio_branch_is_quiet_on_a_tone(spark):
    rows = [(1, k, 0.0707, 0.055, 0.0) for k in range(8)] + [(2, k, 0.5 if k in (3, 4) else 0.01, 0.1, 0.2) for k in range(12)]
    df = spark.createDataFrame(rows, "clip_id long, pos int, rms double, centroid double, clipping double")
    got = {r.clip_id: r for r in B.audio(df).collect()}
    assert got[1].score is None and got[1].confidence == 0 and got[2].score == 0.4


def test_missing_tools_say_so(spark):
    seen = {r.name: r for r in adapters.availability(spark).collect()}
    assert all(r.available == (not r.missing) for r in seen.values())
    clips = spark.createDataFrame([(1,)], "clip_id long")
    a = adapters.Adapter("nothing", "face", ("no_such_module",))
    r = adapters.unavailable(clips, a).first()
    assert r.status == "unavailable" and r.score is None and "no_such_module" in r.warning


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(b"\xef\xbb\xbf" + b'{"name": "a", "fusion": {"score": 0.5}}')
    (tmp_path / "b.json").write_bytes('{"name": "b", "fusion": {"score": 0.7}}'.encode("utf-16"))
    (tmp_path / "c.json").write_bytes(b"no json")
    got = {r.path[-6:]: r.report for r in files.reports(spark, str(tmp_path), "name string, fusion struct<score: double>").collect()}
    assert got["a.json"].name == "a" and got["b.json"].fusion.score == 0.7 and got["c.json"].name is None if got["c.json"] else True
    p = {r.path[-6:]: r for r in files.provenance(spark, str(tmp_path)).collect()}
    assert p["c.json"].container == "json" and p["c.json"].size_bytes == 7
    out = spark.createDataFrame([(1, 0.5)], "k int, v double")
    files.write_reports(out, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").first().v == 0.5
    with pytest.raises(Exception, match="NaN"):
        files.write_reports(spark.createDataFrame([(float("nan"),)], "v double"), f"{tmp_path}/bad")


def test_audit(spark):
    rows = [{"score": 0.9, "expected": "positive"}, {"score": 0.1, "expected": "negative"}, {"score": 0.8}]
    r = E.audit(reports(spark, *rows)).first()
    assert r.metrics.tp == r.metrics.tn == 1 and r.counts.unlabeled_count == 1 and r.ranking.auroc == 1.0 and r.medians.gap == 0.8
    nothing = E.audit(reports(spark, {"score": 0.5})).first()
    assert nothing.metrics.coverage is None and nothing.counts.unlabeled_count == 1
