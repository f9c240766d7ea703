"""Queries of branches on stand-in frames and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.catalogue import query, written
from palisade.functions import kernels, tiles as T
from palisade.operators import analyze, branches as B
from palisade.plans.fusion import FUSED_SQL
from palisade.plans.standins import BRANCH_SQL, FRAME_SQL, SIGNAL_SQL, SPECTRA_SQL, frames, mosaics, signals
from palisade.plans.tiles import SOUND_SQL
from palisade.session import table

_CHANGE = "WITH " + FRAME_SQL + """, sg AS (SELECT clip_id, pos, list_transform(tiles, lambda x: x / 32) AS s FROM frames),
ch AS (SELECT b.clip_id, b.pos, list_avg(list_transform(list_zip(a.s, b.s), lambda z: abs(z[1] - z[2]))) AS d FROM sg a JOIN sg b ON a.clip_id = b.clip_id AND b.pos = a.pos + 1),
m AS (SELECT clip_id, count(*) AS n, quantile_cont(d, 0.5) AS c FROM ch GROUP BY clip_id),
fl AS (SELECT clip_id, d <= 0.65 AS f, pos - row_number() OVER (PARTITION BY clip_id, d <= 0.65 ORDER BY pos) AS g FROM ch),
rn AS (SELECT clip_id, coalesce(max(k) FILTER (WHERE f), 0) AS run FROM (SELECT clip_id, f, g, count(*) AS k FROM fl GROUP BY ALL) GROUP BY clip_id)
"""


def signatures(spark, sf_dir):
    return frames(spark, sf_dir).select("clip_id", "pos", "frame_index", F.transform("tiles", lambda x: x / 32).alias("signature"))


def _six(df, *more):
    return df.select("clip_id", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"), *more)


@query(_CHANGE + """, lg AS (SELECT clip_id, n, unnest(range(2, 1 + greatest(2, least(11, (n + 1) // 2)))) AS lag FROM m),
rt AS (
  SELECT clip_id, max(r) AS rate FROM (
    SELECT a.clip_id, lag, avg(CASE WHEN list_avg(list_transform(list_zip(a.s, b.s), lambda z: abs(z[1] - z[2]))) <= 1.0 THEN 1.0 ELSE 0.0 END) AS r
    FROM sg a JOIN lg ON lg.clip_id = a.clip_id JOIN sg b ON b.clip_id = a.clip_id AND b.pos = a.pos - lag GROUP BY a.clip_id, lag) GROUP BY clip_id
), q AS (
  SELECT clip_id, n, run, greatest(0.0, least(1.0, (c - 0.65) / 3)) AS motion, least(1.0, 0.55 * greatest(0.0, least(1.0, (run - 1) / greatest(2.0, n * 0.35::DOUBLE))) + 0.45 * rate * greatest(0.0, least(1.0, (c - 0.65) / 3))) AS s
  FROM m JOIN rn USING (clip_id) JOIN rt USING (clip_id)
)
SELECT clip_id, CASE WHEN run >= 3 AND motion >= 0.2 AND s >= 0.25 THEN round(s, 6) END AS score,
       CASE WHEN run >= 3 AND motion >= 0.2 AND s >= 0.25 THEN round(least(1.0, (n + 1) / 12.0::DOUBLE), 6) ELSE 0 END AS confidence, run AS longest_run FROM q
""")
def periodicity_branch(spark, sf_dir):
    return _six(B.periodicity(signatures(spark, sf_dir)), "longest_run")


@query(_CHANGE + """, sd AS (
  SELECT b.clip_id, b.pos, list_avg(list_transform(list_zip(a.s, b.s, c.s), lambda z: abs(z[2] - (z[1] + z[3]) / 2))) / (list_avg(list_transform(list_zip(a.s, c.s), lambda z: abs(z[1] - z[2]))) + 0.05) AS r,
         list_avg(list_transform(list_zip(a.s, c.s), lambda z: abs(z[1] - z[2]))) + 0.05 AS motion
  FROM sg a JOIN sg b ON a.clip_id = b.clip_id AND b.pos = a.pos + 1 JOIN sg c ON c.clip_id = b.clip_id AND c.pos = b.pos + 1
), rc AS (SELECT clip_id, count(*) AS k, quantile_cont(r, 0.5) AS c FROM sd GROUP BY clip_id), rm AS (SELECT clip_id, quantile_cont(abs(r - c), 0.5) AS mad FROM sd JOIN rc USING (clip_id) GROUP BY clip_id),
ev AS (SELECT clip_id, count(*) FILTER (WHERE r < c - greatest(2 * (mad + 1e-6), 0.12) AND motion > 1) AS e FROM sd JOIN rc USING (clip_id) JOIN rm USING (clip_id) GROUP BY clip_id)
SELECT clip_id, CAST(NULL AS DOUBLE) AS score, round(least(1.0, (k + 2) / 16.0::DOUBLE), 6) AS confidence,
  round(least(1.0, 0.45 * least(1.0, e / greatest(2.0, k * 0.2::DOUBLE)) + 0.35 * greatest(0.0, least(1.0, (c - 1) / 2)) + 0.2 * greatest(0.0, least(1.0, (run - 1) / greatest(2.0, (k + 1) * 0.3::DOUBLE)))), 6) AS diagnostic_score
FROM rc JOIN rm USING (clip_id) JOIN ev USING (clip_id) JOIN rn USING (clip_id)
""")
def resampling_branch(spark, sf_dir):
    return _six(B.resampling(signatures(spark, sf_dir)), F.round("diagnostic_score", 6).alias("diagnostic_score"))


@query("WITH " + FRAME_SQL + """, q AS (
  SELECT clip_id, pos, (tile // 8) // 2 * 4 + (tile % 8) // 2 AS k,
         sum(v) FILTER (WHERE (tile // 8) % 2 = 0 AND tile % 2 = 0) AS a, sum(v) FILTER (WHERE (tile // 8) % 2 = 0 AND tile % 2 = 1) AS b,
         sum(v) FILTER (WHERE (tile // 8) % 2 = 1 AND tile % 2 = 0) AS c, sum(v) FILTER (WHERE (tile // 8) % 2 = 1 AND tile % 2 = 1) AS d
  FROM tiles GROUP BY ALL
), e AS (
  SELECT clip_id, pos, avg(abs(a + b + c + d)) / 2 AS ll, avg(abs(a + b - c - d)) / 2 AS lh, avg(abs(a - b + c - d)) / 2 AS hl, avg(abs(a - b - c + d)) / 2 AS hh FROM q GROUP BY clip_id, pos
), v AS (SELECT clip_id, pos, ll / (ll + 1e-6) AS x1, lh / (ll + 1e-6) AS x2, hl / (ll + 1e-6) AS x3, hh / (ll + 1e-6) AS x4 FROM e),
dl AS (SELECT b.clip_id, b.pos, (abs(a.x1 - b.x1) + abs(a.x2 - b.x2) + abs(a.x3 - b.x3) + abs(a.x4 - b.x4)) / 4 AS d FROM v a JOIN v b ON a.clip_id = b.clip_id AND b.pos = a.pos + 1),
m AS (SELECT clip_id, count(*) AS n, quantile_cont(d, 0.5) AS c FROM dl GROUP BY clip_id), sp AS (SELECT clip_id, quantile_cont(abs(d - c), 0.5) AS s FROM dl JOIN m USING (clip_id) GROUP BY clip_id),
ev AS (SELECT clip_id, count(*) FILTER (WHERE d > c + 4 * (s + 1e-6) AND d > greatest(0.02, c * 2.5)) AS e FROM dl JOIN m USING (clip_id) JOIN sp USING (clip_id) GROUP BY clip_id),
mv AS (SELECT b.clip_id, b.pos, b.k, abs(abs(b.a - b.b - b.c + b.d) * 0.5 - abs(a.a - a.b - a.c + a.d) * 0.5) AS x FROM q a JOIN q b ON a.clip_id = b.clip_id AND b.pos = a.pos + 1 AND a.k = b.k),
mc AS (SELECT clip_id, pos, quantile_cont(x, 0.5) AS c, quantile_cont(x, 0.9) AS p FROM mv GROUP BY clip_id, pos),
ml AS (SELECT clip_id, pos, (any_value(p) - any_value(c)) / (quantile_cont(abs(x - c), 0.5) + 1e-6) AS z FROM mv JOIN mc USING (clip_id, pos) GROUP BY clip_id, pos),
lc AS (SELECT clip_id, count(*) FILTER (WHERE z > 4) AS l FROM ml GROUP BY clip_id),
r AS (SELECT clip_id, n, e, least(1.0, 0.45 * greatest(0.0, least(1.0, s / (c + 0.01) * 2)) + 0.30 * least(1.0, e / greatest(2.0, n * 0.25::DOUBLE)) + 0.25 * least(1.0, l / greatest(2.0, n * 0.25::DOUBLE))) AS x
      FROM m JOIN sp USING (clip_id) JOIN ev USING (clip_id) JOIN lc USING (clip_id))
SELECT clip_id, CASE WHEN n >= 4 AND x >= 0.35 THEN round(x, 6) END AS score, round(least(1.0, n / 8.0::DOUBLE) * CASE WHEN e > 0 THEN 1 ELSE 0.6::DOUBLE END, 6) AS confidence, CAST(e AS INTEGER) AS events FROM r
""")
def wavelet_branch(spark, sf_dir):
    return _six(B.wavelet(frames(spark, sf_dir), 8), "events")


@query("WITH " + FRAME_SQL + """, m AS (SELECT clip_id, frame_index, quantile_cont(v, 0.5) AS c FROM tiles GROUP BY clip_id, frame_index),
d AS (SELECT frame_index, quantile_cont(abs(v - c), 0.5) AS s FROM tiles JOIN m USING (clip_id, frame_index) GROUP BY frame_index),
z AS (SELECT t.clip_id, t.frame_index, tile % 4 AS tile, (v - c) / (s + 0.00001) AS z, c, row_number() OVER (PARTITION BY t.frame_index ORDER BY v DESC, t.tile) AS k FROM tiles t JOIN m ON m.frame_index = t.frame_index JOIN d ON d.frame_index = t.frame_index),
h AS (SELECT clip_id, frame_index, greatest(0.0, avg(z) FILTER (WHERE k <= 6)) AS hot, max(tile) FILTER (WHERE k = 1) AS tile, any_value(c) / 1000 AS noise FROM z GROUP BY clip_id, frame_index),
a AS (SELECT clip_id, count(*) AS n, quantile_cont(hot, 0.5) AS med, quantile_cont(noise, 0.5) AS noise FROM h GROUP BY clip_id),
b AS (SELECT clip_id, quantile_cont(abs(hot - med), 0.5) AS mad FROM h JOIN a USING (clip_id) GROUP BY clip_id),
p AS (SELECT clip_id, max(k) AS k FROM (SELECT clip_id, tile, count(*) AS k FROM h GROUP BY clip_id, tile) GROUP BY clip_id),
s AS (
  SELECT clip_id, n, k / n::DOUBLE AS per, noise, greatest(0.0, least(1.0, (med - 2) / 8)) AS loc, greatest(0.0, least(1.0, (k / n::DOUBLE - 0.15) / 0.55)) AS st, least(1.0, mad / (med + 0.001) / 2) AS ins
  FROM a JOIN b USING (clip_id) JOIN p USING (clip_id)
), x AS (SELECT *, least(1.0, 0.55 * loc * st + 0.45 * loc * ins) AS raw FROM s), y AS (SELECT *, n >= 4 AND raw >= 0.25 AND loc >= 0.45 AND per >= 0.75 AND noise < 0.12 AS ok FROM x)
SELECT clip_id, CASE WHEN ok THEN round(raw, 6) END AS score, CASE WHEN ok THEN round(least(1.0, n / 8.0::DOUBLE), 6) ELSE 0 END AS confidence, round(per, 6) AS persistence FROM y
""")
def spatial_branch(spark, sf_dir):
    t = F.col("tiles")
    from palisade.functions import robust as R

    rows = frames(spark, sf_dir).select("clip_id", "pos", T.hotspot(t).alias("hotspot"), (T.hottest(t) % 4).alias("hot_tile"), (R.array_median(t) / 1000).alias("noise"))
    return _six(B.spatial(rows), F.round("persistence", 6).alias("persistence"))


@query("WITH " + SIGNAL_SQL + """, g AS (SELECT clip_id, CAST(pos - lag(pos) OVER (PARTITION BY clip_id ORDER BY pos) AS DOUBLE) AS g FROM sig WHERE event_type = 'signup'),
t AS (SELECT clip_id, seconds - lag(seconds) OVER (PARTITION BY clip_id ORDER BY pos) AS t FROM sig),
n AS (SELECT clip_id, count(*) AS n FROM sig GROUP BY clip_id HAVING count(*) >= 8),
gm AS (SELECT clip_id, count(g) AS k, quantile_cont(g, 0.5) AS c FROM g WHERE g IS NOT NULL GROUP BY clip_id), gd AS (SELECT clip_id, quantile_cont(abs(g - c), 0.5) AS s FROM g JOIN gm USING (clip_id) WHERE g IS NOT NULL GROUP BY clip_id),
tm AS (SELECT clip_id, quantile_cont(t, 0.5) AS tc FROM t WHERE t IS NOT NULL GROUP BY clip_id), td AS (SELECT clip_id, quantile_cont(abs(t - tc), 0.5) AS ts FROM t JOIN tm USING (clip_id) WHERE t IS NOT NULL GROUP BY clip_id)
SELECT clip_id, CASE WHEN n >= 12 AND k > 0 THEN round(0.7 * least(1.0, 4 * s / coalesce(nullif(c, 0), 1)) + 0.3 * least(1.0, 8 * ts / coalesce(nullif(tc, 0), 1)), 6) END AS score,
       CASE WHEN k > 0 THEN round(least(1.0, n / 60.0::DOUBLE), 6) ELSE 0 END AS confidence, n AS frames
FROM n LEFT JOIN gm USING (clip_id) LEFT JOIN gd USING (clip_id) LEFT JOIN tm USING (clip_id) LEFT JOIN td USING (clip_id)
""")
def codec_branch(spark, sf_dir):
    rows = signals(spark, sf_dir).select("clip_id", "pos", (F.col("event_type") == "signup").alias("key"), "seconds")
    return _six(B.codec(rows), "frames")


@query("WITH " + FRAME_SQL + """, s AS (SELECT clip_id, pos, tile, v / sum(v) OVER (PARTITION BY frame_index) AS h FROM tiles),
d AS (SELECT b.clip_id, b.pos, sqrt(greatest(0.0, 1 - sum(sqrt(a.h * b.h)))) AS d FROM s a JOIN s b ON a.clip_id = b.clip_id AND b.pos = a.pos + 1 AND a.tile = b.tile GROUP BY b.clip_id, b.pos),
m AS (SELECT clip_id, count(*) AS n, quantile_cont(d, 0.5) AS c, max(d) AS hi FROM d GROUP BY clip_id), e AS (SELECT clip_id, quantile_cont(abs(d - c), 0.5) AS s FROM d JOIN m USING (clip_id) GROUP BY clip_id)
SELECT clip_id, CAST(any_value(n) AS INTEGER) AS comparisons, round(any_value(c), 6) AS median_distance, round(any_value(hi), 6) AS max_distance,
       round(count(*) FILTER (WHERE d >= 0.35 OR (d - c) / (1.4826 * s + 1e-9) >= 6) / any_value(n)::DOUBLE, 6) AS cut_rate
FROM d JOIN m USING (clip_id) JOIN e USING (clip_id) GROUP BY clip_id
""")
def scene_branch(spark, sf_dir):
    from palisade.operators import sequence as S

    total = F.aggregate("tiles", F.lit(0.0), lambda s, v: s + v)
    rows = frames(spark, sf_dir).withColumn("total", total).withColumn("h", F.transform("tiles", lambda v: v / F.col("total")))
    both = S.pairs(rows, ["clip_id"], "pos", "h").where(F.col("previous").isNotNull())
    out = B.scene(both.select("clip_id", "pos", T.histogram_distance(F.col("previous"), F.col("h")).alias("distance")))
    return out.select("clip_id", "comparisons", *(F.round(c, 6).alias(c) for c in ("median_distance", "max_distance", "cut_rate")))


@query("""
WITH s AS (SELECT o_orderkey AS clip_id, (o_orderkey % 50) / 20.0::DOUBLE AS a, CASE WHEN o_orderkey % 11 > 0 THEN (o_custkey % 60) / 15.0::DOUBLE END AS b FROM orders)
SELECT clip_id, CASE WHEN a >= 0.35 AND b >= 0.5 THEN round(least(1.0, 0.65 * least(1.0, (a - 0.35) / 1.5) + 0.35 * least(1.0, (b - 0.5) / 3)), 6) END AS score,
       CASE WHEN a >= 0.35 AND b >= 0.5 THEN 0.7::DOUBLE ELSE 0 END AS confidence FROM s
""")
def avsync_branch(spark, sf_dir):
    from palisade.session import table

    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("clip_id"), ((k % 50) / 20.0).alias("video_start"), F.lit(0.0).alias("audio_start"), F.when(k % 11 > 0, (F.col("o_custkey") % 60) / 15.0).alias("video_duration"), F.lit(0.0).alias("audio_duration")
    )
    return _six(B.avsync(rows))


def _stats_sql(source, out, *columns):
    """SQL of count, median, MAD and outlier share of columns of `source` by clip, as `out`."""
    by = "PARTITION BY clip_id"
    rows = [f"SELECT clip_id, '{c}' AS c, {c} AS x FROM {source} WHERE {c} IS NOT NULL" for c in columns]
    one = f"""{out}_x AS ({" UNION ALL ".join(rows)}), {out}_m AS (SELECT clip_id, c, x, quantile_cont(x, 0.5) OVER ({by}, c) AS m FROM {out}_x),
{out}_d AS (SELECT *, quantile_cont(abs(x - m), 0.5) OVER ({by}, c) AS d FROM {out}_m), {out}_g AS (
  SELECT clip_id, c, count(*) AS n, any_value(m) AS med, any_value(d) AS mad,
         CASE WHEN count(*) < 3 THEN 0 ELSE avg(CASE WHEN d < 1e-9 THEN CASE WHEN abs(x - m) > 1e-9 THEN 1.0::DOUBLE ELSE 0 END WHEN abs(x - m) > 3.5 * 1.4826 * d THEN 1.0::DOUBLE ELSE 0 END) END AS o
  FROM {out}_d GROUP BY clip_id, c
)"""
    wide = ", ".join(f"coalesce(any_value({s}) FILTER (WHERE c = '{c}'), 0) AS {c}_{t}" for c in columns for s, t in (("n", "n"), ("med", "med"), ("mad", "mad"), ("o", "out")))
    return f"{one}, {out} AS (SELECT clip_id, {wide} FROM {out}_g GROUP BY clip_id)"


@query("WITH " + SPECTRA_SQL + ", fq AS (SELECT clip_id, pos, noise, high, ratio FROM ns JOIN sp USING (clip_id, pos) JOIN rt USING (clip_id, pos)), " + _stats_sql("fq", "st", "noise", "high", "ratio") + """
SELECT clip_id, CASE WHEN high_n >= 4 THEN round(least(1.0, 0.15 * least(1.0, 5 * noise_mad / (noise_med + 0.005)) + 0.20 * least(1.0, 3 * high_mad / (high_med + 0.01)) + 0.25 * least(1.0, 4 * ratio_mad / (coalesce(nullif(ratio_med, 0), 1) + 0.1))
  + 0.20 * ratio_out + 0.20 * greatest(0.0, least(1.0, (coalesce(nullif(ratio_med, 0), 1) - 1) / 3))), 6) END AS score, CASE WHEN high_n >= 4 THEN round(least(1.0, high_n / 8.0::DOUBLE), 6) ELSE 0 END AS confidence FROM st
""")
def frequency_branch(spark, sf_dir):
    """Noise, high frequencies and the tiles of the residual of mosaic frames."""
    import numpy as np

    from palisade.operators import pixels as P

    high = lambda f: kernels.high_pass(f, 1.2)
    kinds = {"noise": lambda f: float(high(f).std() / 255), "high": kernels.radial_ratio, "ratio": lambda f: P.ratio(P.tile_means(np.abs(high(f))), 1e-3)}
    made = mosaics(spark, sf_dir)
    return _six(B.frequency(made.select("clip_id", "pos", *(kernels.frame_udf(f, 24)(F.col("pixels")).alias(n) for n, f in kinds.items()))))


@query("WITH " + SOUND_SQL + """, sr AS (SELECT clip_id, slot, round(rms, 6) AS rms, round(centroid, 6) AS centroid, round(clipping, 6) AS clipping FROM sw), jp AS (
  SELECT clip_id, slot, abs(ln(rms + 1e-4) - lag(ln(rms + 1e-4)) OVER w) AS jump, abs(centroid - lag(centroid) OVER w) AS turn, clipping FROM sr WINDOW w AS (PARTITION BY clip_id ORDER BY slot)
), """ + _stats_sql("jp", "st", "jump", "turn") + """, d AS (
  SELECT *, n AS windows, least(1.0, 2 * greatest(0.0, jump_out - 0.15) + 2 * greatest(0.0, turn_out - 0.15) + 20 * greatest(0.0, cl - 0.01)) AS disc
  FROM (SELECT clip_id, count(*) AS n, avg(clipping) AS cl FROM jp GROUP BY clip_id) LEFT JOIN st USING (clip_id)
), sc AS (SELECT *, windows >= 4 AND disc >= 0.25 AS ok, least(1.0, 0.35 * least(1.0, 3 * greatest(0.0, jump_med - 0.15) + 8 * jump_mad) + 0.25 * least(1.0, 20 * greatest(0.0, turn_med - 0.01) + 30 * turn_mad) + 0.40 * disc) AS s FROM d)
SELECT clip_id, CASE WHEN ok THEN round(s, 6) END AS score, CASE WHEN ok THEN round(least(1.0, windows / 8.0::DOUBLE), 6) ELSE 0 END AS confidence, round(disc, 6) AS discontinuity FROM sc
""")
def audio_branch(spark, sf_dir):
    from palisade.plans.tiles import sound_windows

    return _six(B.audio(sound_windows(spark, sf_dir).withColumnRenamed("slot", "pos")), F.round("discontinuity", 6).alias("discontinuity"))


def _features(spark, sf_dir):
    v = F.col("value") / 40
    return signals(spark, sf_dir).select("clip_id", "pos", v.alias("x"), F.sqrt(v).alias("y"), (1 + v / 2).alias("z"), (v % 1).alias("w"))


def _c(x):
    return f"greatest(0.0, least(1.0, {x}))"


@query("WITH " + SIGNAL_SQL + ", ft AS (SELECT clip_id, pos, value / 40 AS x, sqrt(value / 40) AS y, 1 + value / 80 AS z, (value / 40) % 1 AS w FROM sig), " + _stats_sql("ft", "st", "x", "y", "z", "w") + f""",
cv AS (SELECT clip_id, stddev_pop(z) / (avg(z) + 1e-6) AS cv FROM ft GROUP BY clip_id),
r AS (
  SELECT clip_id, 'temporal' AS branch, 1 AS branch_order, x_n >= 3 AS ok, least(1.0, x_n / 10.0::DOUBLE) * least(1.0, 30 * x_n / 20.0::DOUBLE) AS conf,
         0.25 * {_c(f"greatest(0.0, {_c('3 * x_mad / (x_med + 0.01)')} - 0.75) * 2")} + 0.20 * {_c("greatest(0.0, x_out - 0.20) * 4")} + 0.35 * {_c("greatest(0.0, y_out - 0.25) * 4")} * {_c("(y_n - 8) / 20.0::DOUBLE")} + 0.20 * {_c("greatest(0.0, z_out - 0.15) * 4")} AS s FROM st
  UNION ALL
  SELECT clip_id, 'recompression', 2, x_n >= 4, least(1.0, x_n / 8.0::DOUBLE),
         0.20 * {_c("4 * x_mad / (x_med + 0.01)")} + 0.20 * {_c("3 * y_mad / (y_med + 0.01)")} + 0.25 * {_c("4 * z_mad / (coalesce(nullif(z_med, 0), 1) + 0.1)")} + 0.20 * z_out + 0.15 * {_c("(coalesce(nullif(z_med, 0), 1) - 1) / 3")} FROM st
  UNION ALL
  SELECT clip_id, 'integrity', 6, x_n >= 4, least(1.0, x_n / 8.0::DOUBLE),
         {_c(f"0.25 * {_c('greatest(0.0, x_out - 0.15) * 3.5')} + 0.20 * {_c('y_med / 2.5')} + 0.20 * {_c('greatest(0.0, w_med - 0.04) * 3')} + 0.20 * {_c('greatest(0.0, z_out - 0.15) * 3.5')} + 0.15 * {_c('4 * x_mad / (x_med + 0.001)')}")} * least(1.0, 0.5 + {_c("y_med / coalesce(nullif(z_med, 0), 1)")}) FROM st
  UNION ALL
  SELECT clip_id, 'face', 4, conf >= 0.3 AND x_n >= 4 AND cv >= 0.10 AND s >= 0.25, conf, s FROM (
    SELECT *, least(1.0, x_n / 12.0::DOUBLE) AS conf, {_c("0.35 * x_mad / coalesce(nullif(x_med, 0), 0.02) + 0.35 * y_mad / coalesce(nullif(y_med, 0), 0.01) + 0.90 * cv")} AS s FROM st JOIN cv USING (clip_id))
)
SELECT clip_id, branch, CAST(branch_order AS INTEGER) AS branch_order, 'ok' AS status, CASE WHEN ok THEN round({_c("s")}, 6) END AS score, CASE WHEN ok THEN round(conf, 6) ELSE 0 END AS confidence FROM r
""")
def decoder_branches(spark, sf_dir):
    """The formulas of the branches that look at pixels, on stand-in features; pixel_branches has them from pixels."""
    f = _features(spark, sf_dir)
    temporal = B.temporal(f.select("clip_id", "pos", F.lit(3).alias("gap"), F.col("x").alias("error"), F.col("y").alias("flow"), F.col("z").alias("local"), F.lit(30).alias("tracked")))
    recompression = B.recompression(f.select("clip_id", "pos", F.col("x").alias("residual"), F.col("y").alias("block"), F.col("z").alias("ratio")))
    integrity = B.integrity(f.select("clip_id", "pos", F.col("x").alias("residual"), F.col("y").alias("divergence"), F.col("w").alias("occlusion"), F.col("z").alias("contrast"), F.col("y").alias("without"), F.col("x").alias("dct")))
    clips = f.groupBy("clip_id").agg(F.count("*").alias("frames"), F.lit(1.0).alias("candidates"), F.lit(9).alias("flow_pairs"))
    face = B.face(f.select("clip_id", "pos", F.col("x").alias("move"), F.col("y").alias("resize"), F.col("z").alias("geometry")), clips)
    return B.union(temporal, recompression, integrity, face).withColumns({"score": F.round("score", 6), "confidence": F.round("confidence", 6)})


_ENERGY = "WITH " + FRAME_SQL + """, q AS (
  SELECT clip_id, frame_index, (tile // 8) // 2 * 4 + (tile % 8) // 2 AS k,
         sum(v) FILTER (WHERE (tile // 8) % 2 = 0 AND tile % 2 = 0) AS a, sum(v) FILTER (WHERE (tile // 8) % 2 = 0 AND tile % 2 = 1) AS b,
         sum(v) FILTER (WHERE (tile // 8) % 2 = 1 AND tile % 2 = 0) AS c, sum(v) FILTER (WHERE (tile // 8) % 2 = 1 AND tile % 2 = 1) AS d
  FROM tiles GROUP BY ALL
), w AS (SELECT clip_id, frame_index, k, (a + b + c + d) / 2 AS v FROM q),
q2 AS (
  SELECT clip_id, frame_index, (k // 4) // 2 * 2 + (k % 4) // 2 AS k2, sum(v) FILTER (WHERE (k // 4) % 2 = 0 AND k % 2 = 0) AS a, sum(v) FILTER (WHERE (k // 4) % 2 = 0 AND k % 2 = 1) AS b,
         sum(v) FILTER (WHERE (k // 4) % 2 = 1 AND k % 2 = 0) AS c, sum(v) FILTER (WHERE (k // 4) % 2 = 1 AND k % 2 = 1) AS d
  FROM w GROUP BY ALL
), s AS (SELECT frame_index, avg(abs(v)) + 1e-6 AS s FROM w GROUP BY frame_index),
e AS (
  SELECT clip_id, frame_index, avg(abs(a + b + c + d)) / 2 AS ll, avg(abs(a + b - c - d)) / 2 AS lh, avg(abs(a - b + c - d)) / 2 AS hl, avg(abs(a - b - c + d)) / 2 AS hh FROM q2 GROUP BY clip_id, frame_index
)
"""


@query(_ENERGY + """
SELECT clip_id, count(*) AS frames, round(quantile_cont(ll / s, 0.5), 6) AS level2_ll, round(quantile_cont(lh / s, 0.5), 6) AS level2_lh, round(quantile_cont(hl / s, 0.5), 6) AS level2_hl, round(quantile_cont(hh / s, 0.5), 6) AS level2_hh
FROM e JOIN s USING (frame_index) GROUP BY clip_id
""")
def wavelet_levels(spark, sf_dir):
    """Median energies of the second level's bands."""
    return B.wavelet_levels(frames(spark, sf_dir), 8)


#: SQL of the shared sample of frames, at most 32 of each clip, in place of all frames.
_SAMPLED = """
every AS (
  SELECT label AS clip_id, vec_id AS frame_index, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place, count(*) OVER (PARTITION BY label) AS n,
         list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)) * 255) AS tiles
  FROM embeddings
), frames AS (
  SELECT clip_id, frame_index, row_number() OVER (PARTITION BY clip_id ORDER BY place) - 1 AS pos, tiles FROM every
  WHERE list_contains(list_transform(range(least(32, n)), lambda i: CASE WHEN i = least(32, n) - 1 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / (least(32, n) - 1)::DOUBLE)) AS BIGINT) END), place)
), tiles AS (
  SELECT clip_id, frame_index, pos, unnest(range(64)) AS tile, unnest(tiles) AS v FROM frames
)"""


def _sampled_sql(name, order):
    own = written(f"{name}_branch").replace(FRAME_SQL, _SAMPLED)
    return f"SELECT clip_id, '{name}' AS branch, {order} AS branch_order, 'ok' AS status, score, true AS has_confidence, CAST(confidence AS VARCHAR) AS confidence_raw, CAST(NULL AS VARCHAR) AS coverage_raw, CAST(NULL AS VARCHAR) AS observed_raw, {name != 'resampling'} AS fusion_eligible FROM ({own})"


_ROWS = " UNION ALL ".join(_sampled_sql(n, B.REGISTRY[n].order) for n in ("periodicity", "wavelet", "spatial", "resampling"))


def _inputs(spark, sf_dir):
    """The branches' inputs from one shared sample of frames."""
    return _made(analyze.shared_sample(frames(spark, sf_dir), 32))


def _made(shared):
    from palisade.functions import robust as R

    t = F.col("tiles")
    signed = shared.select("clip_id", "pos", "frame_index", F.transform("tiles", lambda x: x / 32).alias("signature"))
    spots = shared.select("clip_id", "pos", T.hotspot(t).alias("hotspot"), (T.hottest(t) % 4).alias("hot_tile"), (R.array_median(t) / 1000).alias("noise"))
    return {"periodicity": (signed,), "wavelet": (shared, 8), "spatial": (spots,), "resampling": (signed,)}


@query(_ROWS)
def analyzed_branches(spark, sf_dir):
    """Branch rows as reports have them, made through the registry from one sample."""
    return analyze.branch_rows(_inputs(spark, sf_dir)).drop("metrics")


@query("WITH br AS (SELECT * FROM (" + _ROWS + ") WHERE score IS NOT NULL), clips AS (SELECT label AS clip_id, label % 5 = 0 AS quality_confounder, 9.0::DOUBLE AS detection_frames FROM embeddings GROUP BY label)" + FUSED_SQL.removeprefix("WITH " + BRANCH_SQL) + """
SELECT clip_id, evidence_set, CASE WHEN abstain THEN 'abstain-insufficient-evidence' WHEN final < 0.3 THEN 'low-anomaly-signal' WHEN final < 0.62 THEN 'mixed-anomaly-signal' ELSE 'high-anomaly-signal' END AS label,
  round(final, 6) AS score, CAST(coalesce(g, 0) AS INTEGER) AS group_count, CASE WHEN nothing THEN 0 ELSE round(least(1.0, cov), 6) END AS evidence_coverage FROM f
""")
def analyze_all(spark, sf_dir):
    """Frames to fused scores in one plan."""
    found = table(spark, sf_dir, "embeddings").select(F.col("label").alias("clip_id")).distinct()
    of = found.select("clip_id", (F.col("clip_id") % 5 == 0).alias("quality_confounder"), F.lit(9.0).alias("detection_frames"))
    return analyze.analyze(_inputs(spark, sf_dir), of).select("clip_id", "evidence_set", "label", "score", "group_count", "evidence_coverage")


#: SQL of each cell's own sample, as frames of a clip of its own: label * 10000 + window * 1000 + budget.
_CELLED = """
every AS (
  SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place, count(*) OVER (PARTITION BY label) AS n,
         list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)) * 255) AS tiles
  FROM embeddings
), g0 AS (SELECT label, n, w, b, greatest(0.0, (n / 8.0::DOUBLE - w) / 2) AS s FROM (SELECT DISTINCT label, n FROM every), (VALUES (2), (4)) ws(w), (VALUES (8), (16)) bs(b) WHERE n >= 2 AND n / 8.0::DOUBLE + 1e-6 >= w),
g1 AS (SELECT *, least(n - 1, CAST(round_even(s * 8, 0) AS BIGINT)) AS lo, least(n - 1, CAST(round_even((s + w) * 8, 0) AS BIGINT) - 1) AS hi FROM g0),
g2 AS (SELECT *, least(b, hi - lo + 1) AS k FROM g1 WHERE hi > lo),
g3 AS (SELECT DISTINCT label, w, b, CASE WHEN i = k - 1 THEN hi ELSE CAST(floor(lo + i * ((hi - lo) / (k - 1)::DOUBLE)) AS BIGINT) END AS place FROM (SELECT *, unnest(range(k)) AS i FROM g2)),
frames AS (
  SELECT label * 10000 + w * 1000 + b AS clip_id, vec_id * 10000 + w * 1000 + b AS frame_index, row_number() OVER (PARTITION BY label, w, b ORDER BY place) - 1 AS pos, tiles
  FROM g3 JOIN every USING (label, place)
), tiles AS (SELECT clip_id, frame_index, pos, unnest(range(64)) AS tile, unnest(tiles) AS v FROM frames)"""
_CELL_ROWS = _ROWS.replace(_SAMPLED, _CELLED)


@query("WITH br AS (SELECT * FROM (" + _CELL_ROWS + ") WHERE score IS NOT NULL), clips AS (SELECT DISTINCT clip_id, (clip_id // 10000) % 5 = 0 AS quality_confounder, 9.0::DOUBLE AS detection_frames FROM (WITH " + _CELLED + " SELECT clip_id FROM frames))" + FUSED_SQL.removeprefix("WITH " + BRANCH_SQL) + """
SELECT CAST(clip_id // 10000 AS BIGINT) AS clip_id, CAST(clip_id % 10000 AS BIGINT) AS cell, evidence_set,
  CASE WHEN abstain THEN 'abstain-insufficient-evidence' WHEN final < 0.3 THEN 'low-anomaly-signal' WHEN final < 0.62 THEN 'mixed-anomaly-signal' ELSE 'high-anomaly-signal' END AS label,
  round(final, 6) AS score, CAST(coalesce(g, 0) AS INTEGER) AS group_count, CASE WHEN nothing THEN 0 ELSE round(least(1.0, cov), 6) END AS evidence_coverage FROM f
""")
def window_analysis(spark, sf_dir):
    """Each window of each budget, from its own frames through its own branches to its fused scores."""
    rows = frames(spark, sf_dir)
    counted = rows.groupBy("clip_id").agg(F.count("*").alias("frame_count")).withColumn("fps", F.lit(8.0)).withColumn("duration_seconds", F.col("frame_count") / F.col("fps"))
    cells, own, _ = analyze.window_samples(rows, counted, [2, 4], [8, 16])
    of = counted.select("clip_id", (F.col("clip_id") % 5 == 0).alias("quality_confounder"), F.lit(9.0).alias("detection_frames"))
    out = analyze.analyze_windows(_made(own), cells, of)
    return out.select(F.col("clip_id").cast("long").alias("clip_id"), "cell", "evidence_set", "label", "score", "group_count", "evidence_coverage")
