"""Robust statistics and sequence operators on small, hand-worked inputs."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palisade.functions import kernels, tiles
from palisade.functions import robust as R
from palisade.operators import sequence as S

NAN, INF = float("nan"), float("inf")


def one(spark, column, **values):
    kinds = {list: "array<double>", float: "double", int: "int"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_no_evidence_drops_out(spark):
    rows = [(1.0,), (None,), (NAN,), (INF,), (3.0,)]
    df = spark.createDataFrame(rows, "v double").withColumn("k", F.lit(1))
    r = R.summary(df, ["k"], "v").first()
    assert (r.n, r.median, r.mad, r.outlier_fraction) == (2, 2.0, 1.0, 0.0)
    empty = R.summary(df.where("v IS NULL"), ["k"], "v").first()
    assert empty.n == 0 and empty.median is None and empty.mad is None


@pytest.mark.parametrize("values, share", [([5.0] * 8, 0.0), ([1.0, 1.0, 1.0, 10.0], 0.25), ([1.0, 9.0], 0.0), ([1.0, 2.0, 3.0, 4.0, 100.0], 0.2)])
def test_outlier_fraction(spark, values, share):
    df = spark.createDataFrame([(1, v) for v in values], "k int, v double")
    assert R.summary(df, ["k"], "v").first().outlier_fraction == share
    assert one(spark, R.array_outlier_fraction(F.col("a")), a=values) == share


def test_clipped_and_falsy(spark):
    assert one(spark, R.clipped(F.col("a")), a=1.5) == 1.0
    assert one(spark, R.clipped(F.col("a")), a=NAN) is None
    assert one(spark, R.falsy(F.col("a"), 0.02), a=0.0) == 0.02


def test_array_statistics_match_numpy(spark):
    rng = np.random.default_rng(0)
    lists = [rng.normal(size=n).tolist() for n in (1, 2, 3, 8, 15)]
    df = spark.createDataFrame([(x,) for x in lists], "a array<double>")
    a = F.col("a")
    rows = df.select("a", R.array_median(a).alias("m"), R.array_mad(a).alias("d"), R.array_percentile(a, 0.9).alias("p")).collect()
    for r in rows:
        m = np.median(r.a)
        assert np.isclose(r.m, m) and np.isclose(r.d, np.median(np.abs(np.array(r.a) - m))) and np.isclose(r.p, np.percentile(r.a, 90))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=3, max_size=20), st.floats(-50, 50))
def test_shift_leaves_spread(spark, values, by):
    df = spark.createDataFrame([(1, v) for v in values], "k int, v double")
    a, b = R.summary(df, ["k"], "v").first(), R.summary(df.withColumn("v", F.col("v") + by), ["k"], "v").first()
    assert abs(a.mad - b.mad) < 1e-9 and abs(a.median + by - b.median) < 1e-9


def test_order_of_rows_does_not_matter(spark):
    rows = [(k % 3, random.Random(k).random()) for k in range(90)]
    df = spark.createDataFrame(rows, "k int, v double")
    a, b = (sorted(R.summary(d, ["k"], "v").collect()) for d in (df.repartition(1), df.orderBy(F.rand(3)).repartition(7)))
    assert a == b


def test_longest_run(spark):
    df = spark.createDataFrame([(1, i, f) for i, f in enumerate([True, False, True, True, True, False, True])], "k int, i int, f boolean")
    assert R.longest_run(df, ["k"], "i", "f").first().longest_run == 3
    assert R.longest_run(df.where("NOT f"), ["k"], "i", "f").first().longest_run == 0


@pytest.mark.parametrize("n, most", [(1, 5), (2, 5), (10, 1), (10, 4), (97, 12), (5, 5), (0, 3)])
def test_uniform_positions(spark, n, most):
    got = spark.range(1).select(S.uniform_positions(F.lit(n).cast("long"), most).alias("x")).first().x
    want = np.linspace(0, n - 1, min(most, n), dtype=int).tolist() if n else []
    assert got == want


def test_outside_cuts(spark):
    pairs = spark.createDataFrame([(1, k, k + 1) for k in range(8)], "clip_id int, a long, b long")
    cuts = spark.createDataFrame([(1, 4)], "clip_id int, cut long")
    assert sorted(r.a for r in S.outside_cuts(pairs, cuts, ["clip_id"], "a", "b", "cut").collect()) == [0, 1, 6, 7]


def test_adaptive_sample_keeps_ends_and_peaks(spark):
    rows = [(1, k, 9.0 if k in (17, 23) else 0.1) for k in range(1, 40)] + [(1, 0, None)]
    df = spark.createDataFrame(rows, "clip_id int, pos long, change double")
    got = {r.pos for r in S.adaptive_sample(df, ["clip_id"], "pos", "change", 8).collect()}
    assert {0, 39} <= got and len(got) <= 10


def test_tiles(spark):
    a = [float(k) for k in range(64)]
    assert one(spark, tiles.hottest(F.col("a")), a=a) == 63
    assert one(spark, tiles.block_means(F.col("a"), 8, 2, 2), a=a) == [13.5, 17.5, 45.5, 49.5]
    assert len(one(spark, tiles.proportional_means(F.col("a"), 8, 3, 3), a=a)) == 9
    frame = np.array(a).reshape(8, 8)
    bands = {n: one(spark, c, a=a) for n, c in tiles.haar(F.col("a"), 8).items()}
    q = [frame[i::2, j::2] for i in (0, 1) for j in (0, 1)]
    assert np.allclose(np.array(bands["ll"]).reshape(4, 4), sum(q) / 2)
    assert np.allclose(np.array(bands["lh"]).reshape(4, 4), (q[0] + q[1] - q[2] - q[3]) / 2)


def test_kernels():
    rng = np.random.default_rng(0)
    frame = rng.uniform(0, 255, (32, 48))
    assert np.allclose(kernels.high_pass(np.full((9, 9), 7.0), 1.2), 0)
    assert kernels.radial_ratio(frame) > kernels.radial_ratio(np.add.outer(np.arange(32.0), np.arange(48.0)))
    barred = np.zeros((80, 160))
    barred[8:72, 10:150] = 120 + rng.uniform(0, 5, (64, 140))
    assert kernels.content(barred).shape == (144, 256) and kernels.content(barred).min() > 100
    blocks = np.kron(rng.uniform(0, 255, (4, 6)), np.ones((8, 8)))
    assert kernels.blockiness(blocks) > 100 and kernels.dct_energy(blocks) < 1e-9
    assert np.isclose(kernels.hue_saturation(rng.integers(0, 255, (50, 3))).sum(), 1)
    y, x = np.mgrid[0:9, 0:9].astype(float)
    assert kernels.divergence(np.dstack([x, y])) == 16 and kernels.divergence(np.dstack([y, x])) == 0
    there = np.dstack([x * 0 + 2, x * 0 - 1])
    assert kernels.occlusion(there, -there) == 0 and kernels.occlusion(there, there) == 1
    assert kernels.gray(np.full((2, 2, 3), 50)).round(6).tolist() == [[50, 50], [50, 50]]
    rms, centroid, clipped = kernels.sound(0.1 * np.sin(2 * np.pi * 440 * np.arange(2000) / 8000), 8000)
    assert abs(rms - 0.0707) < 0.001 and abs(centroid - 440 / 8000) < 0.005 and clipped == 0
