"""Clips of fewer frames than the shared sample keep their subset."""

from pyspark.sql import functions as F

from palisade.plans import sequence


def test_short_clips_stay(spark, tmp_path):
    # user n has n events
    users = spark.range(1, 31).select(F.col("id").alias("user_id"), F.explode(F.sequence(F.lit(1), "id")).alias("event_id"))
    time = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id"))
    users.select("user_id", "event_id", time.alias("ts"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    got = {}
    for r in sequence.bounded_subset(spark, str(tmp_path)).collect():
        got.setdefault(r.clip_id, []).append(r.pos)
    even = lambda n, m: [k * (n - 1) // max(1, m - 1) for k in range(m)]
    for n in range(1, 31):
        shared = even(n, min(n, 20))
        assert sorted(got[n]) == [shared[k] for k in even(len(shared), min(len(shared), 7))], n
