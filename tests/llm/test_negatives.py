"""Hard negatives against a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from palisade.llm import negatives

KIND = "vec_id long, label int, embedding array<double>"


def plain(rows, positives=5, k=10, every=100):
    ok = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [int(x * 256 // 1) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and abs(x) < float("inf") for x in v)]
    out = []
    for ai, alab, av in ok:
        if ai % every:
            continue
        scored = [(sum(p * q for p, q in zip(av, v)), i, lab) for i, lab, v in ok if len(v) == len(av)]
        for ps, pi in sorted(((s, i) for s, i, lab in scored if lab == alab and i != ai), key=lambda x: (-x[0], x[1]))[:positives]:
            some = sorted(((s, i) for s, i, lab in scored if lab != alab and 30 * ps <= 100 * s <= 90 * ps), key=lambda x: (-x[0], x[1]))[:k]
            out += [(ai, pi, r, i, ps, s) for r, (s, i) in enumerate(some, 1)]
    return sorted(out)


def found(spark, rows, parts=5):
    df = spark.createDataFrame(rows, KIND).withColumns({c: F.lit(1) for c in ("score", "w", "digit", "need", "a", "copy")})
    return sorted(tuple(r) for r in negatives.report(df.repartition(parts)).collect())


@pytest.mark.parametrize("digit", [256, 4])
def test_same_as_plain(spark, monkeypatch, digit):
    """Random vectors, groups of copies, several blocks, small chunks of scores; short digits in the driver's part."""
    rng = random.Random(7)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    monkeypatch.setattr(negatives, "SCORES", 64)
    rows = [(i, rng.randrange(4), [rng.uniform(-1, 1) + 0.5 for _ in range(4)]) for i in range(0, 1200, 3)]
    rows += [(5001 + i, 2, [0.4, 0.5, 0.3, 0.2]) for i in range(90)] + [(700, 3, [0.5, 0.5, 0.5, 0.5])] * 3
    rows += [(100, 1, [0.9, 0.1, 0.4])] + [(6000 + i, i % 3, [0.5, 0.1 * i, 0.2]) for i in range(12)]
    assert found(spark, rows, digit // 32 + 2) == plain(rows)


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    assert found(spark, []) == []
    out = [(None, 1, [1.0]), (100, None, [1.0]), (200, 1, None), (300, 1, [None]), (400, 1, [nan]), (500, 1, [inf]), (600, 1, [])]
    assert found(spark, out) == []
    # ties by the thousand, repeats of a row, no positives, negative scores
    rows = [(100, 1, [1.0, 0.0]), (101, 1, [1.0, 0.0]), *((1001 + k, 3, [0.5, 0.0]) for k in range(500)), (200, 5, [1.0, 1.0]), (301, 8, [-1.0, 0.0]), (400, 8, [1.0, 0.0])]
    rows += [(2, 4, [0.5, 0.0])] * 12
    assert found(spark, rows) == plain(rows)
    got = found(spark, rows)
    assert [r[3] for r in got if r[0] == 100] == [2] * 10 and not [r for r in got if r[0] == 400]


def test_scores_of_any_size():
    import numpy as np

    x, q = np.array([[2.0**40, -(2.0**40)], [1e300, 1.0], [0.5, 0.25]]), np.array([[2.0**40, 2.0**40], [1.0, 3.0]])
    want = [[min(max(sum(int(a * 256) * int(b * 256) for a, b in zip(u, v)), -(2**63)), 2**63 - 1) for v in q] for u in x]
    assert negatives.scores(x, q).tolist() == want
