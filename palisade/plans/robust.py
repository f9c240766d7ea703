"""Queries of the robust statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palisade.catalogue import query
from palisade.functions import robust as R
from palisade.session import table

_MAD = """
WITH m AS (SELECT user_id, count(*) AS n, quantile_cont(value, 0.5) AS median FROM events GROUP BY user_id),
d AS (SELECT user_id, quantile_cont(abs(value - median), 0.5) AS mad FROM events JOIN m USING (user_id) GROUP BY user_id)
"""


@query(_MAD + """
SELECT user_id, n, median, mad, p10, p90
FROM m JOIN d USING (user_id)
JOIN (SELECT user_id, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.9) AS p90 FROM events GROUP BY user_id) USING (user_id)
""")
def robust_summary_by_user(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    tails = R.quantiles(events, ["user_id"], "value", {"p10": 0.1, "p90": 0.9}).drop("n")
    return R.summary(events, ["user_id"], "value").drop("outlier_fraction").join(tails, "user_id")


@query(_MAD + """
SELECT user_id, CASE WHEN any_value(n) < 3 THEN 0.0
  ELSE count(*) FILTER (WHERE CASE WHEN mad < 1e-9 THEN abs(value - median) > 1e-9
                                   ELSE abs(value - median) / (1.4826 * mad) > 3.5 END) / count(*)::DOUBLE END AS outlier_fraction
FROM events JOIN m USING (user_id) JOIN d USING (user_id) GROUP BY user_id
""")
def outlier_fraction_by_user(spark, sf_dir):
    return R.summary(table(spark, sf_dir, "events"), ["user_id"], "value").select("user_id", "outlier_fraction")


@query(_MAD + """
SELECT event_id, user_id, round((value - median) / (1.4826 * mad + 1e-9), 6) AS z
FROM events JOIN m USING (user_id) JOIN d USING (user_id)
""")
def robust_z_events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    stats = R.summary(events, ["user_id"], "value")
    z = R.robust_z(F.col("value"), F.col("median"), F.col("mad"))
    return events.join(stats, "user_id").select("event_id", "user_id", F.round(z, 6).alias("z"))


@query("""
WITH e AS (
  SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events
), p AS (SELECT a.user_id, a.event_id, a.value, b.value AS past FROM e a JOIN e b ON a.user_id = b.user_id AND b.k < a.k),
m AS (SELECT user_id, event_id, any_value(value) AS value, quantile_cont(past, 0.5) AS c, count(*) AS n FROM p GROUP BY user_id, event_id),
d AS (SELECT user_id, event_id, quantile_cont(abs(past - c), 0.5) AS s FROM p JOIN m USING (user_id, event_id) GROUP BY user_id, event_id)
SELECT user_id, event_id, n, round((value - c) / (1.4826 * s + 1e-9), 6) AS z,
       n > 5 AND (value - c) / (1.4826 * s + 1e-9) > 6 AS excluded
FROM m JOIN d USING (user_id, event_id)
""")
def expanding_robust_z(spark, sf_dir):
    """Each value against all before it."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    past = R.expanding(events, ["user_id"], ["ts", "event_id"], "value").where("past_n > 0")
    z = R.robust_z(F.col("value"), F.col("past_median"), F.col("past_mad"))
    n = F.col("past_n")
    return past.select("user_id", "event_id", n.alias("n"), F.round(z, 6).alias("z"), ((n > 5) & (z > 6)).alias("excluded"))


@query("""
WITH m AS (SELECT l_suppkey, count(*) AS n, quantile_cont(l_extendedprice, 0.5) AS c FROM lineitem GROUP BY l_suppkey),
d AS (SELECT l_suppkey, quantile_cont(abs(l_extendedprice - c), 0.5) AS s FROM lineitem JOIN m USING (l_suppkey) GROUP BY l_suppkey)
SELECT l_suppkey, any_value(n) AS n, any_value(c) AS median, any_value(s) AS mad,
       CASE WHEN any_value(n) < 3 THEN 0.0 ELSE
         count(*) FILTER (WHERE CASE WHEN s < 1e-9 THEN abs(l_extendedprice - c) > 1e-9 ELSE abs(l_extendedprice - c) / (1.4826 * s) > 3.5 END)
         / count(*)::DOUBLE END AS outlier_fraction
FROM lineitem JOIN m USING (l_suppkey) JOIN d USING (l_suppkey) GROUP BY l_suppkey
""")
def outlier_fraction_by_supplier(spark, sf_dir):
    return R.summary(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice")


@query("""
SELECT event_id, CASE WHEN isfinite(x) THEN greatest(0.0, least(1.0, x)) END AS clipped
FROM (SELECT event_id, CASE WHEN event_id % 10 = 3 THEN NULL WHEN event_id % 10 = 4 THEN 'nan'::DOUBLE
             WHEN event_id % 10 = 5 THEN 'inf'::DOUBLE ELSE value / 100 END AS x FROM events)
""")
def clipped_values(spark, sf_dir):
    k = F.col("event_id") % 10
    x = F.when(k == 3, None).when(k == 4, float("nan")).when(k == 5, float("inf")).otherwise(F.col("value") / 100)
    return table(spark, sf_dir, "events").select("event_id", R.clipped(x).alias("clipped"))


@query("""
SELECT user_id, round(stddev_pop(value) / (avg(value) + 1e-6), 6) AS cv, quantile_cont(value, 0.95) AS p95
FROM events GROUP BY user_id
""")
def variation_by_user(spark, sf_dir):
    x = R.finite("value")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.round(F.stddev_pop(x) / (F.avg(x) + 1e-6), 6).alias("cv"), R.percentile("value", 0.95).alias("p95")
    )


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k, sum(n) OVER (PARTITION BY user_id) AS total FROM c)
SELECT user_id, event_type AS mode, n AS mode_count, round(n / total::DOUBLE, 6) AS persistence FROM r WHERE k = 1
""")
def mode_by_user(spark, sf_dir):
    """The most frequent value, ties to the first by name."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").count()
    ranked = counts.withColumn("rank", -F.rank().over(Window.partitionBy("user_id").orderBy("event_type")))
    top = ranked.groupBy("user_id").agg(F.max_by(F.struct("event_type", "count"), F.struct("count", "rank")).alias("top"), F.sum("count").alias("total"))
    return top.select("user_id", F.col("top.event_type").alias("mode"), F.col("top.count").alias("mode_count"), F.round(F.col("top.count") / F.col("total"), 6).alias("persistence"))
