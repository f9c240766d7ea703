"""Whitening against one eigendecomposition of the covariance."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from palisade.llm import whitening


def direct(v, components=32):
    x = np.floor(64 * v).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    apart = n * x - sums
    centred = apart / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return (apart**2).sum(axis=1), e, np.trace(centred.T @ centred / n), centred @ u / np.sqrt(np.maximum(e, 1e-300))


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_same_as_direct(spark, monkeypatch, parts):
    monkeypatch.setattr(whitening, "WAYS", 3)
    t = pq.read_table("/root/testdata/sf0.001/embeddings.parquet")
    v = np.array(t["embedding"].to_pylist(), dtype=np.float64)
    dev, e, trace, want = direct(v)
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").repartition(parts)
    out = whitening.report(df).toPandas().sort_values(["vec_id", "component"])
    order = np.argsort(t["vec_id"].to_numpy())
    got = out.whitened.to_numpy().reshape(len(v), 32)
    sign = np.sign((got * want[order]).sum(axis=0))
    assert np.abs(got * sign - want[order]).max() < 1e-9
    assert (out.deviation.to_numpy().reshape(-1, 32) == dev[order][:, None]).all()
    assert np.allclose(out.explained.to_numpy().reshape(-1, 32)[0], e / trace, rtol=1e-9)
    assert set(out.n) == {len(v)} and out.identity_error.nunique() == 1 and out.identity_error.iloc[0] < 1e-9


def test_merging_loses_nothing():
    """Parts far apart, fewer rows than dimensions, one row: as the SVD of all rows together."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-50, 50, (k, 6)) + at for k, at in ((1, 10**6), (3, 10**6 + 4000), (40, 10**6), (2, 10**7))])
    merged, at = None, 0
    for k in (1, 3, 40, 2):
        part = whitening.Part.of(x[at : at + k])
        merged, at = part if merged is None else merged.merge(part), at + k
    values = np.linalg.svd((len(x) * x - x.sum(axis=0)) / len(x), compute_uv=False)
    assert np.allclose(merged.values, values, rtol=1e-12) and merged.sums == x.sum(axis=0).tolist() and merged.n == 46
    assert np.allclose(merged.vectors @ merged.vectors.T, np.eye(6), atol=1e-12)


def rows(spark, some):
    df = spark.createDataFrame(some, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("n", "d", "v", "at", "whitened", "label")})
    return whitening.report(df).collect()


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    assert rows(spark, []) == [] and rows(spark, [(1, None), (2, [None]), (3, [nan]), (4, [inf]), (5, [])]) == []
    one = rows(spark, [(1, [0.5, 0.25])])
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 1, 0, None, None, 0.0), (1, 2, 1, 0, None, None, 0.0)]
    # two lengths, repeats, a null id, a constant dimension
    some = [(1, [1.0, 0.5]), (1, [1.0, 0.5]), (None, [2.0, 0.5]), (9, [1.0, 2.0, 3.0]), (8, [2.0, 2.0, 5.0])]
    out = rows(spark, some)
    assert {(r.n, r.component) for r in out} == {(3, 1), (3, 2), (2, 1), (2, 2), (2, 3)} and len(out) == 12
    flat = {(r.n, r.component) for r in out if r.whitened is None}
    assert flat == {(3, 2), (2, 2), (2, 3)} and all(r.identity_error < 1e-12 for r in out)
    assert {r.deviation for r in out if r.n == 3} == {64**2, 128**2}
    big = rows(spark, [(k, [1e300 * k, 1.0]) for k in range(3)])
    assert max(r.deviation for r in big) == 2**63 - 1 and all(np.isfinite(r.whitened) for r in big if r.component == 1)
