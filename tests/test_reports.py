"""Reports of JSON files with branches and fields that aren't known beforehand."""

import json

import pytest
from pyspark.sql import functions as F

from palisade.operators import evaluate as E
from palisade.sources import reports as R


def whole(score, branches, **more):
    return {"fusion": {"score": score, "label": "mixed-anomaly-signal", "evidence_coverage": 0.9, "group_score_range": 0.1, "instability_score": 0}, "branches": branches} | more


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("reports")
    some = {
        "a": (whole(0.9, {"y": {"score": 0.8}, "x": {"score": "0.7"}}), "utf-8"),
        "b": (whole("0.2", {"y": {"score": None}, "x": {"score": 0.1}, "z": {}}), "utf-8-sig"),
        "c": (whole(True, {"x": {"score": "no number"}, "odd.name": {"score": 0.4}}), "utf-16"),
        "d": (whole(None, ["no", "object"], fusion_sets={"legacy": {"score": 0.95, "label": "high-anomaly-signal", "reason_codes": ["one", "two"]}}), "utf-16-be"),
        "f": (whole(float("inf"), {"w": 3}), "utf-8"),
    }
    for name, (report, kind) in some.items():
        text = json.dumps(report, allow_nan=True).replace("Infinity", "1e999")
        (path / f"{name}.json").write_bytes((b"\xfe\xff" if kind == "utf-16-be" else b"") + text.encode(kind))
    (path / "e.json").write_text("{broken")
    return str(path)


@pytest.fixture(scope="module")
def found(spark, folder):
    truth = spark.createDataFrame([("a", "positive"), ("b", "negative"), ("c", "negative"), ("f", "other")], "name string, expected string")
    return R.files(spark, folder).join(truth, "name", "left")


def test_files_of_several_encodings(found):
    rows = {r.name: r for r in R.flat(found).collect()}
    assert {n: rows[n].score for n in "abcdef"} == {"a": 0.9, "b": 0.2, "c": 1.0, "d": None, "e": None, "f": None}
    assert rows["a"].label == "mixed-anomaly-signal" and rows["e"].label is None and rows["a"].expected == "positive"
    legacy = {r.name: r for r in R.flat(found, "legacy").collect()}
    assert legacy["d"].score == 0.95 and legacy["d"].reason_codes == ["one", "two"] and legacy["a"].score is None
    with pytest.raises(ValueError):
        R.flat(found, "some")


def test_missing_null_and_present(found):
    at = {r.name: (r.y, r.z) for r in found.select("name", R.presence("report", "branches.y.score").alias("y"), R.presence("report", "branches.z").alias("z")).collect()}
    assert at["a"] == ("present", "missing") and at["b"] == ("null", "present") and at["c"] == ("missing", "missing") and at["e"] == ("missing", "missing")


def test_branches_come_from_the_data(found):
    rows = {(r.name, r.branch): r.score for r in R.branch_rows(found).collect()}
    assert rows == {("a", "y"): 0.8, ("a", "x"): 0.7, ("b", "y"): None, ("b", "x"): 0.1, ("b", "z"): None, ("c", "x"): None, ("c", "odd.name"): 0.4, ("f", "w"): None}


def test_what_labelled_reports_lack(found):
    rows = {r.branch: r for r in E.diagnostics(R.branch_rows(found), found).collect()}
    assert {b: r.missing_or_invalid for b, r in rows.items()} == {"x": 1, "y": 2, "z": 3, "odd.name": 2, "w": 3}
    assert rows["x"].auroc == 1.0 and rows["x"].gap == 0.6 and rows["y"].auroc is None and rows["y"].positives == 1 and rows["z"].positives == 0


def test_decisions_and_ranking(found):
    judged = E.classify(R.flat(found))
    assert {r.name: r.predicted for r in judged.collect()} == {"a": "positive", "b": "negative", "c": "positive", "d": "abstain", "e": "abstain", "f": "abstain"}
    rows = E.ranking(judged).orderBy("rank").collect()
    assert [(r.name, r["rank"], r.reasons, r.abstain_reasons) for r in rows] == [("c", 1, [], []), ("a", 2, [], []), ("b", 3, [], [])]
    directional = {r.name: (r.score, r.n_qualifying, r.evidence_coverage) for r in R.flat(found, "directional").collect()}
    assert set(directional.values()) == {(0.0, 0, 0.0)}
    points = {r.positive_threshold: r for r in E.operating_points(R.flat(found)).collect()}
    assert points[0.9].tp == 1 and points[0.95].tp == 0 and points[0.95].labeled == 3


def test_no_reports(found):
    none = found.where(F.lit(False))
    assert R.flat(none).count() == R.branch_rows(none).count() == E.diagnostics(R.branch_rows(none), none).count() == 0
