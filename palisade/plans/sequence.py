"""Queries of sampling and sequence operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palisade.catalogue import query
from palisade.functions import robust as R
from palisade.operators import sequence as S
from palisade.plans.standins import FRAME_SQL, SIGNAL_SQL, frames, signals

KEY = ["clip_id"]

_UNIFORM = """
u AS (
  SELECT clip_id, i, CASE WHEN i = m - 1 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / (m - 1)::DOUBLE)) AS BIGINT) END AS pos
  FROM (SELECT clip_id, n, least({most}, n) AS m, unnest(range(least({most}, n))) AS i FROM (SELECT clip_id, count(*) AS n FROM {of} GROUP BY clip_id))
)"""


@query("WITH " + SIGNAL_SQL + "," + _UNIFORM.format(most=12, of="sig") + "SELECT DISTINCT clip_id, pos FROM u")
def uniform_sample(spark, sf_dir):
    return S.uniform_sample(signals(spark, sf_dir), KEY, "pos", 12).select("clip_id", F.col("pos").cast("long").alias("pos"))


@query("WITH " + SIGNAL_SQL + "," + _UNIFORM.format(most=20, of="sig") + """, s AS (
  SELECT clip_id, pos, row_number() OVER (PARTITION BY clip_id ORDER BY pos) - 1 AS place, count(*) OVER (PARTITION BY clip_id) AS n FROM u
)
SELECT clip_id, pos FROM s
WHERE list_contains(list_transform(range(least(7, n)), lambda i: CASE WHEN i = least(7, n) - 1 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / (least(7, n) - 1)::DOUBLE)) AS BIGINT) END), place)
""")
def bounded_subset(spark, sf_dir):
    """A branch's smaller sample of the shared one."""
    shared = S.uniform_sample(signals(spark, sf_dir), KEY, "pos", 20)
    return S.uniform_sample(shared, KEY, "pos", 7).select("clip_id", F.col("pos").cast("long").alias("pos"))


@query("WITH " + SIGNAL_SQL + "," + _UNIFORM.format(most=12, of="sig") + """
SELECT clip_id, (max(pos) - min(pos)) / greatest(1, max(n) - 1)::DOUBLE AS span_coverage, round(max(pos) / 24.0::DOUBLE, 6) AS last_seconds
FROM u JOIN (SELECT clip_id, count(*) AS n FROM sig GROUP BY clip_id) USING (clip_id) GROUP BY clip_id
""")
def span_coverage(spark, sf_dir):
    rows = signals(spark, sf_dir)
    n = rows.groupBy("clip_id").agg(F.count("*").alias("n"))
    taken = S.uniform_sample(rows, KEY, "pos", 12).groupBy("clip_id").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    span = (F.col("b") - F.col("a")) / F.greatest(F.lit(1), F.col("n") - 1)
    return taken.join(n, "clip_id").select("clip_id", span.alias("span_coverage"), F.round(F.col("b") / 24.0, 6).alias("last_seconds"))


_MOTION = """, motion AS (
  SELECT clip_id, pos, abs(value - lag(value) OVER (PARTITION BY clip_id ORDER BY pos)) AS change
  FROM sig JOIN (SELECT clip_id, count(*) AS n FROM sig GROUP BY clip_id) USING (clip_id)
  WHERE pos % greatest(1, n // 40) = 0
)"""


def _motion(spark, sf_dir):
    rows = signals(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("clip_id")))
    kept = S.strided(rows, "pos", F.col("n"), 40)
    return S.pairs(kept, KEY, "pos", "value").select("clip_id", "pos", F.abs(F.col("value") - F.col("previous")).alias("change"))


@query("WITH " + SIGNAL_SQL + _MOTION + "SELECT clip_id, pos, change FROM motion WHERE change IS NOT NULL")
def motion_candidates(spark, sf_dir):
    return _motion(spark, sf_dir).where(F.col("change").isNotNull()).select("clip_id", F.col("pos").cast("long").alias("pos"), "change")


@query("WITH " + SIGNAL_SQL + _MOTION + """, ranked AS (
  SELECT clip_id, pos, row_number() OVER (PARTITION BY clip_id ORDER BY change DESC, pos) AS k FROM motion WHERE change IS NOT NULL
), place AS (SELECT clip_id, pos, row_number() OVER (PARTITION BY clip_id ORDER BY pos) - 1 AS place, count(*) OVER (PARTITION BY clip_id) AS n FROM motion),
even AS (
  SELECT p.clip_id, p.pos FROM place p
  JOIN (SELECT clip_id, n, m, unnest(range(m)) AS i FROM (SELECT DISTINCT clip_id, n, least(12, n) AS m FROM place)) g ON g.clip_id = p.clip_id
   AND p.place = CASE WHEN i = m - 1 THEN g.n - 1 ELSE CAST(floor(i * ((g.n - 1) / (m - 1)::DOUBLE)) AS BIGINT) END
), both_ AS (SELECT clip_id, pos FROM even UNION SELECT clip_id, pos FROM ranked WHERE k <= 4),
bp AS (SELECT clip_id, pos, row_number() OVER (PARTITION BY clip_id ORDER BY pos) - 1 AS place, count(*) OVER (PARTITION BY clip_id) AS n FROM both_)
SELECT p.clip_id, p.pos FROM bp p
JOIN (SELECT clip_id, n, m, unnest(range(m)) AS i FROM (SELECT DISTINCT clip_id, n, least(12, n) AS m FROM bp)) g ON g.clip_id = p.clip_id
 AND p.place = CASE WHEN i = m - 1 THEN g.n - 1 ELSE CAST(floor(i * ((g.n - 1) / (m - 1)::DOUBLE)) AS BIGINT) END
UNION SELECT clip_id, min(pos) FROM motion GROUP BY clip_id UNION SELECT clip_id, max(pos) FROM motion GROUP BY clip_id
""")
def adaptive_sample(spark, sf_dir):
    return S.adaptive_sample(_motion(spark, sf_dir), KEY, "pos", "change", 12).select("clip_id", F.col("pos").cast("long").alias("pos"))


_JUMPS = """, j AS (
  SELECT clip_id, pos, abs(value - lag(value) OVER (PARTITION BY clip_id ORDER BY pos)) AS d FROM sig
), jm AS (SELECT clip_id, count(d) AS n, quantile_cont(d, 0.5) AS c FROM j WHERE d IS NOT NULL GROUP BY clip_id),
jd AS (SELECT clip_id, quantile_cont(abs(d - c), 0.5) AS s FROM j JOIN jm USING (clip_id) WHERE d IS NOT NULL GROUP BY clip_id)
"""


def _jumps(spark, sf_dir):
    rows = S.pairs(signals(spark, sf_dir), KEY, "pos", "value")
    return rows.select("clip_id", "pos", "gap", F.abs(F.col("value") - F.col("previous")).alias("d")).where(F.col("d").isNotNull())


@query("WITH " + SIGNAL_SQL + _JUMPS + "SELECT clip_id, n, c AS median, s AS mad FROM jm JOIN jd USING (clip_id)")
def adjacent_jump_summary(spark, sf_dir):
    return R.summary(_jumps(spark, sf_dir), KEY, "d").drop("outlier_fraction")


@query("WITH " + SIGNAL_SQL + _JUMPS + """
SELECT clip_id, pos, round(d, 6) AS d FROM j JOIN jm USING (clip_id) JOIN jd USING (clip_id)
WHERE d >= 60 OR (d - c) / (1.4826 * s + 1e-9) >= 6
""")
def cut_detection(spark, sf_dir):
    """Cuts: a change beyond a bound, or six robust deviations from the clip's changes."""
    jumps = _jumps(spark, sf_dir)
    stats = R.summary(jumps, KEY, "d").select("clip_id", "median", "mad")
    z = R.robust_z(F.col("d"), F.col("median"), F.col("mad"))
    return jumps.join(stats, "clip_id").where((F.col("d") >= 60) | (z >= 6)).select("clip_id", F.col("pos").cast("long").alias("pos"), F.round("d", 6).alias("d"))


@query("WITH " + SIGNAL_SQL + _JUMPS + """
SELECT clip_id, pos FROM j JOIN jm USING (clip_id) JOIN jd USING (clip_id) WHERE d > c + 4 * (s + 1e-6) AND d > greatest(0.02, 2.5 * c)
""")
def burst_events(spark, sf_dir):
    jumps = _jumps(spark, sf_dir)
    stats = R.summary(jumps, KEY, "d").select("clip_id", "median", "mad")
    burst = (F.col("d") > F.col("median") + 4.0 * (F.col("mad") + 1e-6)) & (F.col("d") > F.greatest(F.lit(0.02), 2.5 * F.col("median")))
    return jumps.join(stats, "clip_id").where(burst).select("clip_id", F.col("pos").cast("long").alias("pos"))


@query("WITH " + SIGNAL_SQL + _JUMPS + """, cuts AS (
  SELECT clip_id, pos FROM j JOIN jm USING (clip_id) JOIN jd USING (clip_id) WHERE d >= 60 OR (d - c) / (1.4826 * s + 1e-9) >= 6
)
SELECT clip_id, count(*) AS pairs, quantile_cont(d, 0.5) AS median FROM j
WHERE d IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cuts WHERE cuts.clip_id = j.clip_id AND (abs(cuts.pos - j.pos) <= 1 OR abs(cuts.pos - (j.pos - 1)) <= 1))
GROUP BY clip_id
""")
def cut_excluded_pairs(spark, sf_dir):
    jumps = _jumps(spark, sf_dir).withColumn("pos", F.col("pos").cast("long")).withColumn("before", F.col("pos") - 1)
    cuts = cut_detection(spark, sf_dir).select("clip_id", F.col("pos").alias("cut"))
    kept = S.outside_cuts(jumps, cuts, KEY, "before", "pos", "cut")
    return kept.groupBy("clip_id").agg(F.count("*").alias("pairs"), R.median("d").alias("median"))


@query("WITH " + SIGNAL_SQL + """, s AS (
  SELECT clip_id, pos, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM sig WINDOW w AS (PARTITION BY clip_id ORDER BY pos)
), r AS (SELECT clip_id, pos, abs(value - (a + b) / 2) / (abs(b - a) + 0.05) AS r, abs(b - a) + 0.05 AS motion FROM s WHERE a IS NOT NULL AND b IS NOT NULL),
c AS (SELECT clip_id, quantile_cont(r, 0.5) AS c FROM r GROUP BY clip_id),
m AS (SELECT clip_id, quantile_cont(abs(r - c), 0.5) + 1e-6 AS m FROM r JOIN c USING (clip_id) GROUP BY clip_id)
SELECT clip_id, pos, round(r, 6) AS residual, r > 2.5 AS large, r < c - greatest(2 * m, 0.12) AND motion > 1.0 AS interpolated
FROM r JOIN c USING (clip_id) JOIN m USING (clip_id)
""")
def second_difference_events(spark, sf_dir):
    rows = S.pairs(signals(spark, sf_dir), KEY, "pos", "value").where(F.col("previous").isNotNull() & F.col("following").isNotNull())
    motion = F.abs(F.col("following") - F.col("previous")) + 0.05
    rows = rows.select("clip_id", F.col("pos").cast("long").alias("pos"), (F.abs(F.col("value") - (F.col("previous") + F.col("following")) / 2) / motion).alias("r"), motion.alias("motion"))
    stats = R.summary(rows, KEY, "r").select("clip_id", "median", "mad")
    low = F.col("r") < F.col("median") - F.greatest(2.0 * (F.col("mad") + 1e-6), F.lit(0.12))
    return rows.join(stats, "clip_id").select("clip_id", "pos", F.round("r", 6).alias("residual"), (F.col("r") > 2.5).alias("large"), (low & (F.col("motion") > 1.0)).alias("interpolated"))


@query("WITH " + SIGNAL_SQL + _JUMPS + """, f AS (
  SELECT clip_id, d <= 10 AS flag, pos - row_number() OVER (PARTITION BY clip_id, d <= 10 ORDER BY pos) AS island FROM j WHERE d IS NOT NULL
), r AS (SELECT clip_id, flag, count(*) AS n FROM f GROUP BY clip_id, flag, island)
SELECT clip_id, coalesce(max(n) FILTER (WHERE flag), 0) AS longest_run FROM r GROUP BY clip_id
""")
def longest_run_by_user(spark, sf_dir):
    return R.longest_run(_jumps(spark, sf_dir).withColumn("flag", F.col("d") <= 10), KEY, "pos", "flag")


@query("WITH " + FRAME_SQL + """, n AS (SELECT clip_id, count(*) AS n FROM frames GROUP BY clip_id),
l AS (SELECT clip_id, n, unnest(range(2, 1 + greatest(2, least(11, n // 2)))) AS lag FROM n)
SELECT a.clip_id, CAST(l.lag AS INTEGER) AS lag,
       round(avg(CASE WHEN list_avg(list_transform(list_zip(a.tiles, b.tiles), lambda z: abs(z[1] - z[2]))) <= 28.0 THEN 1.0 ELSE 0.0 END), 6) AS match_rate
FROM frames a JOIN l ON a.clip_id = l.clip_id JOIN frames b ON b.clip_id = a.clip_id AND b.pos = a.pos - l.lag
GROUP BY a.clip_id, l.lag
""")
def lag_match_rate(spark, sf_dir):
    rows = frames(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("clip_id")))
    return S.lag_matches(rows, KEY, "pos", "tiles", lambda a, b: S.l1(a, b) <= 28.0, "n").withColumn("match_rate", F.round("match_rate", 6))


@query("WITH " + FRAME_SQL + """, p AS (SELECT clip_id, frame_index, tiles, lag(tiles) OVER (PARTITION BY clip_id ORDER BY pos) AS before FROM frames)
SELECT clip_id, frame_index, round(list_avg(list_transform(list_zip(tiles, before), lambda z: abs(z[1] - z[2]))), 6) AS distance FROM p WHERE before IS NOT NULL
""")
def signature_l1_adjacent(spark, sf_dir):
    rows = frames(spark, sf_dir).withColumn("before", F.lag("tiles").over(Window.partitionBy("clip_id").orderBy("pos")))
    return rows.where(F.col("before").isNotNull()).select("clip_id", "frame_index", F.round(S.l1(F.col("tiles"), F.col("before")), 6).alias("distance"))


@query("WITH " + SIGNAL_SQL + """
SELECT clip_id, CAST(pos // 8 AS BIGINT) AS slot, round(sqrt(avg(value * value) + 1e-12), 6) AS rms, count(*) FILTER (WHERE abs(value) >= 100) / 8.0::DOUBLE AS clipping
FROM sig GROUP BY clip_id, pos // 8 HAVING count(*) = 8
""")
def fixed_window_rms(spark, sf_dir):
    """Root mean square of windows of eight, the unfinished last one left out."""
    slot = F.floor(F.col("pos") / 8).cast("long")
    out = signals(spark, sf_dir).groupBy("clip_id", slot.alias("slot")).agg(
        F.round(F.sqrt(F.avg(F.col("value") * F.col("value")) + 1e-12), 6).alias("rms"), (F.count_if(F.abs("value") >= 100) / 8.0).alias("clipping"), F.count("*").alias("n")
    )
    return out.where("n = 8").drop("n")


@query("WITH " + SIGNAL_SQL + """, g AS (SELECT clip_id, pos - lag(pos) OVER (PARTITION BY clip_id ORDER BY pos) AS gap FROM sig WHERE event_type = 'signup'),
m AS (SELECT clip_id, count(gap) AS intervals, quantile_cont(CAST(gap AS DOUBLE), 0.5) AS c FROM g WHERE gap IS NOT NULL GROUP BY clip_id)
SELECT clip_id, any_value(intervals) AS intervals, any_value(c) AS median_gop, quantile_cont(abs(gap - c), 0.5) AS gop_interval_mad,
       round(least(1.0, greatest(0.0, 4 * quantile_cont(abs(gap - c), 0.5) / coalesce(nullif(any_value(c), 0.0), 1.0))), 6) AS gop_signal
FROM g JOIN m USING (clip_id) WHERE gap IS NOT NULL GROUP BY clip_id
""")
def gop_intervals(spark, sf_dir):
    """Distances between key frames."""
    keys = signals(spark, sf_dir).where(F.col("event_type") == "signup")
    gap = (F.col("pos") - F.lag("pos").over(Window.partitionBy("clip_id").orderBy("pos"))).cast("double")
    stats = R.summary(keys.withColumn("gap", gap).where("gap IS NOT NULL"), KEY, "gap")
    signal = R.unit(4.0 * R.or_zero(F.col("mad")) / R.falsy(F.col("median"), 1.0))
    return stats.select("clip_id", F.col("n").alias("intervals"), F.col("median").alias("median_gop"), F.col("mad").alias("gop_interval_mad"), F.round(signal, 6).alias("gop_signal"))


@query("WITH " + SIGNAL_SQL + """, g AS (SELECT clip_id, pos - lag(pos) OVER (PARTITION BY clip_id ORDER BY pos) AS gap FROM sig WHERE pos % 3 = 0 OR event_type = 'click')
SELECT clip_id, quantile_cont(CAST(gap AS DOUBLE), 0.5) AS median_gap, quantile_cont(CAST(gap AS DOUBLE), 0.5) <= 60 AS supported
FROM g WHERE gap IS NOT NULL GROUP BY clip_id
""")
def frame_gaps(spark, sf_dir):
    kept = signals(spark, sf_dir).where((F.col("pos") % 3 == 0) | (F.col("event_type") == "click"))
    before = F.lag("pos").over(Window.partitionBy("clip_id").orderBy("pos"))
    gap = F.when(before.isNotNull(), F.greatest(F.lit(1), F.col("pos") - before)).cast("double")
    out = kept.withColumn("gap", gap).groupBy("clip_id").agg(R.median("gap").alias("median_gap"))
    return out.where("median_gap IS NOT NULL").withColumn("supported", F.col("median_gap") <= 60)


@query("WITH " + SIGNAL_SQL + """, p AS (
  SELECT clip_id, pos, value, seconds, lag(value) OVER w AS a, lag(seconds) OVER w AS s FROM sig WINDOW w AS (PARTITION BY clip_id ORDER BY pos)
)
SELECT clip_id, pos, round(sqrt((value - a) * (value - a) + (value / 10 - a / 10) * (value / 10 - a / 10)) / greatest(1.0, (seconds - s) / 3600), 6) AS jump FROM p WHERE a IS NOT NULL
""")
def position_jumps(spark, sf_dir):
    """Movement of a point per hour, by pair."""
    by = Window.partitionBy("clip_id").orderBy("pos")
    a = F.lag("value").over(by)
    jump = F.hypot(F.col("value") - a, F.col("value") / 10 - a / 10) / F.greatest(F.lit(1.0), (F.col("seconds") - F.lag("seconds").over(by)) / 3600)
    return signals(spark, sf_dir).select("clip_id", F.col("pos").cast("long").alias("pos"), F.round(jump, 6).alias("jump")).where("jump IS NOT NULL")
