"""The whole evaluation as tables, written and read again."""

import pytest
from pyspark.sql import functions as F

from palisade.operators import evaluate as E
from palisade.plans.evaluate import long_branches, reports
from palisade.sources import files


def test_sections_come_back(spark, sf_dir, tmp_path):
    rows = reports(spark, sf_dir)
    tables = E.sections(rows, long_branches(spark, sf_dir))
    files.write_evaluation(tables, str(tmp_path / "out"))
    read = {s: spark.read.json(str(tmp_path / "out" / s)) for s in tables}
    judged = {r["name"]: r["predicted"] for r in E.classify(rows).collect()}
    assert {r["name"]: r["predicted"] for r in read["decisions"].collect()} == judged
    ranks = [r["rank"] for r in read["ranking"].orderBy(F.desc("score"), "name").collect()]
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) == rows.where("score BETWEEN 0 AND 1").count()
    summary = read["summary"].first()
    assert summary["metrics"]["labeled"] == rows.where("expected IS NOT NULL").count()
    at = read["operating_points"].where("abs(positive_threshold - 0.65) < 1e-9").first()
    assert at["tp"] + at["fp"] + at["tn"] + at["fn"] + at["abstain"] == at["labeled"] == summary["metrics"]["labeled"]
    assert read["branch_diagnostics"].count() == 4


def test_sections_of_no_reports(spark, sf_dir):
    none, branches = reports(spark, sf_dir).where("false"), long_branches(spark, sf_dir).where("false")
    tables = E.sections(none, branches)
    assert tables["decisions"].count() == tables["ranking"].count() == tables["branch_diagnostics"].count() == 0
    summary = tables["summary"].first()
    assert summary["metrics"]["labeled"] == 0 and summary["metrics"]["sensitivity"] is None and summary["ranking"]["positives"] in (None, 0)


def test_no_folder_of_its_own_on_a_cluster():
    from palisade import session

    class Held:
        isDefined = staticmethod(lambda: False)

    class Context:
        master = "spark://somewhere"

        class _jsc:
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(lambda: Held)})

    class Spark:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda key, other: other)

    with pytest.raises(RuntimeError):
        session.shared_folder(Spark)
