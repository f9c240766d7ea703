"""Rankings hold every report with a valid score."""

import random

from palisade import catalogue
from palisade.operators import evaluate as E


def test_every_row_is_ranked(spark):
    rng = random.Random(4)
    rows = [(k, rng.randrange(20) / 20) for k in range(3000)]
    rng.shuffle(rows)
    out = E.ranked(spark.createDataFrame(rows, "name long, score double").repartition(5), "score", "name").collect()
    assert [(r.score, r.name) for r in sorted(out, key=lambda r: r["rank"])] == sorted((s, n) for n, s in rows)
    assert sorted(r["rank"] for r in out) == list(range(1, 3001))
    assert E.ranked(spark.createDataFrame([], "name long"), "name").count() == 0


def test_ranking_is_not_cut(spark):
    folder = "/root/testdata/sf0.01"
    coverage = catalogue.queries()["ranking_coverage"](spark, folder).first()
    ranks = sorted(r["rank"] for r in catalogue.queries()["anomaly_ranking_all"](spark, folder).collect())
    assert coverage.ranked_report_count > 200 and ranks == list(range(1, coverage.ranked_report_count + 1))
