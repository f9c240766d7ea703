"""Streaming forms against the same rows in one batch."""

from pyspark.sql import functions as F

from palisade.streaming import events as E


def test_streams_agree_with_batches(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("clip_id"), F.col("event_type").alias("branch"), F.col("ts").cast("timestamp").alias("ts"), "value")
    folder = f"{tmp_path}/in"
    rows.orderBy("ts").repartition(3).write.parquet(folder)
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)

    def run(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    got = run(E.running_summary(stream()), "complete", "summary")
    assert sorted(r.n for r in got.collect()) == sorted(r.n for r in E.running_summary(rows).collect())
    # a bin or session is told once the watermark has passed it; none is told twice or differs
    for name, f in (("bins", lambda d: E.bin_support(d, "6 hours", "60 days")), ("sessions", lambda d: E.sessions(d, "2 hours", "60 days"))):
        told = {tuple(r) for r in run(f(stream()), "append", name).collect()}
        assert told <= {tuple(r) for r in f(rows).collect()}


def test_late_events_are_left_out(spark, tmp_path):
    import datetime as dt

    kind = "clip_id long, branch string, ts timestamp, value double"
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    folder = f"{tmp_path}/in"
    for k, part in enumerate(([(1, "a", at(1), 1.0), (1, "b", at(2), 1.0)], [(1, "a", at(500), 1.0)], [(1, "c", at(3), 1.0)], [(1, "a", at(900), 1.0)])):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(kind).parquet(folder)
        q = E.bin_support(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert [(r.clip_id, r.branch_count, r.event_count) for r in rows] == [(1, 2, 2)]
