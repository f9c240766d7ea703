"""Of labelled rows only verified near copies are left out."""

import random

from palisade.llm import toxicity


def test_only_near_copies_are_left_out(spark):
    rng = random.Random(3)
    text = lambda n: [f"w{rng.randrange(100_000)}" for _ in range(n)]
    # "1084923" has the smallest crc of all of these words: unrelated texts that share it stay
    rows = [(k, " ".join(["1084923", *text(60)]), float(k % 2)) for k in range(200)]
    long = text(400)
    rows += [(1000 + k, " ".join(long[: 200 - k] + ["x"] + long[200 - k :]), 1.0) for k in range(30)]
    rows += [(2000, " ".join(long), 0.0), (2001, " ".join(long[:200]), 1.0), (3000, rows[0][1], 0.0), (3000, rows[0][1], 0.0), (4000, "", 1.0), (4001, None, 1.0), (4002, " a b ", 1.0)]
    out = toxicity.copies(spark.createDataFrame(rows, "doc_id long, text string, label double")).collect()
    assert sorted(r.doc_id for r in out) == [*range(200), 1000, 2000, 2001, 4000, 4002]
