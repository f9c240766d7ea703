"""Statistics of all earlier values, for keys of any size."""

import random

import numpy as np

import pytest

from palisade.functions import longkeys
from palisade.functions import robust as R
from palisade.plans import robust
from pyspark.sql import functions as F


def test_distances_in_order():
    rng = random.Random(6)
    for _ in range(400):
        s = sorted(rng.choice((rng.randrange(6), rng.random() * 6)) * 1.0 for _ in range(rng.randrange(1, 30)))
        c = rng.choice((float(np.median(s)), s[0], s[-1], 2.0))
        assert [longkeys.near_center(s, c, k) for k in range(len(s))] == sorted(abs(v - c) for v in s)


@pytest.mark.parametrize("most, bits", [(10**6, None), (150, 4), (0, 5), (0, 2)])
def test_earlier_values(spark, most, bits):
    rng = random.Random(5)
    odd = (None, float("nan"), float("inf"))
    rows = [(rng.choice((1, 2, None, 3 if k % 7 else 4)), k, rng.choice((*odd, rng.random(), rng.randrange(4) * 1.0))) for k in range(900)]
    out = R.expanding(spark.createDataFrame(rows, "user long, at long, v double"), ["user"], ["at"], "v", most, bits).collect()
    got = {r["at"]: (r.past_n, r.past_median, r.past_mad) for r in out}
    assert len(out) == len(rows)
    for user, at, _ in rows:
        past = np.array([v for u, k, v in rows if u == user and k < at and v not in odd and v == v])
        want = (len(past), *((np.median(past), np.median(abs(past - np.median(past)))) if len(past) else (None, None)))
        assert np.allclose(np.array(got[at], float), np.array(want, float), rtol=1e-12, atol=1e-12, equal_nan=True)


def test_one_user_with_most_events(spark, tmp_path):
    n = 60_000  # 1.8e9 values in growing lists
    events = spark.range(n).select(F.lit(1).alias("user_id"), F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), F.rand(1).alias("value"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert robust.expanding_robust_z(spark, str(tmp_path)).agg(F.count("*"), F.max("n"), F.count("z")).first()[:] == (n - 1, n - 1, n - 1)


def prefixes(values):
    past = []
    for x in values:
        yield longkeys.statistics(past)
        longkeys.insort(past, x)


def test_zones_hold_what_a_block_needs():
    """Zones of any chunks and blocks give what whole sorted lists give: steady, drifting, two-peaked, tied, one-sided values."""
    rng = random.Random(9)
    makers = (
        lambda k: rng.random(),
        lambda k: k * 0.01 + rng.random(),
        lambda k: rng.choice((-5, 5)) + rng.random(),
        lambda k: rng.randrange(3) * 1.0,
        lambda k: rng.expovariate(1) ** 3,
        lambda k: -k * 1.0,
        lambda k: 1.0,
        lambda k: rng.choice((0.0, rng.gauss(0, 1e9))),
    )
    few = 0
    for trial in range(120):
        make, size, width = makers[trial % len(makers)], rng.choice((3, 8, 20)), rng.choice((2, 7, 30))
        values = [make(k) for k in range(rng.choice((60, 400)))]
        want = list(prefixes(values))
        ordered = sorted((x, k // size) for k, x in enumerate(values))
        chunks = [ordered[i : i + width] for i in range(0, len(ordered), width)]
        low, high = np.array([c[0][0] for c in chunks]), np.array([c[-1][0] for c in chunks])
        for start in range(0, len(values), size):
            b, own = start // size, values[start : start + size]
            held = np.array([sum(at < b for _, at in c) for c in chunks])
            bounds, gaps, zone = longkeys.zones_of(low, high, held, len(own))
            zones = [[x for c, z in zip(chunks, zone) if z == k for x, at in c if at < b] for k in range(3)]
            past = longkeys.Zones(bounds, gaps, zones)
            few += sum(gaps) > start // 2
            for k, x in enumerate(own):
                assert longkeys.statistics(past) == want[start + k]
                past.insert(x)
    assert few > 100  # most values are counted, not held, in many blocks


def test_a_long_user_goes_through_many_tasks(spark):
    n = 30_000
    rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.col("id") % 50 + 2).otherwise(1).alias("user"), F.col("id").alias("at"), F.randn(2).alias("v"))
    rows = spark.createDataFrame(rows.toPandas())
    one = R.expanding(rows, ["user"], ["at"], "v")
    many = R.expanding(rows, ["user"], ["at"], "v", 5000, 9)
    tasks = many.where("user = 1").select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()
    assert len(tasks) > 1 and sum(r["count"] for r in tasks) == n * 2 // 3
    assert one.exceptAll(many).isEmpty() and many.count() == n


@pytest.mark.parametrize("most", [10**6, 100, 0])
def test_quantiles_of_long_keys(spark, most):
    rng = random.Random(3)
    odd = (None, float("nan"), float("-inf"))
    rows = [(rng.choice((1, 1, 1, 2, None)), 7, rng.choice((*odd, rng.random(), 0.5, rng.randrange(4) * 1.0))) for _ in range(1500)]
    rows += [(3, 7, 2.0), (4, 7, None)]
    df = spark.createDataFrame(rows, "a long, b long, v double").repartition(6)
    shares = {"low": 0.1, "mid": 0.5, "high": 0.95, "top": 1.0}
    got = {r.a: r for r in R.quantiles(df, ["a", "b"], "v", shares, most).collect()}
    assert got.keys() == {1, 2, 3, 4, None} and got[4].n == 0 and got[4].mid is None
    for a in (1, 2, 3, None):
        x = np.array([v for k, _, v in rows if k == a and v not in odd and v == v])
        assert got[a].n == len(x)
        assert np.allclose([got[a][s] for s in shares], [np.quantile(x, s) for s in shares.values()], rtol=1e-12)
    plain = R.summary(df.where("a IS NOT NULL"), ["a"], "v")
    long = R.summary(df.where("a IS NOT NULL"), ["a"], "v", most)
    rounded = lambda d: d.select("a", "n", *(F.round(c, 12) for c in ("median", "mad", "outlier_fraction")))
    assert rounded(plain).exceptAll(rounded(long)).isEmpty() and long.count() == plain.count() == 4
