"""Queries of tile and signal statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.catalogue import query
from palisade.functions import kernels, robust as R, tiles as T
from palisade.operators import sequence as S
from palisade.plans.standins import FRAME_SQL, SIGNAL_SQL, SPECTRA_SQL, frames, mosaics, signals

_STATS = "WITH " + FRAME_SQL + """, m AS (SELECT frame_index, any_value(clip_id) AS clip_id, quantile_cont(v, 0.5) AS c, quantile_cont(v, 0.9) AS p FROM tiles GROUP BY frame_index),
d AS (SELECT frame_index, quantile_cont(abs(v - c), 0.5) AS s FROM tiles JOIN m USING (frame_index) GROUP BY frame_index)
"""


@query(_STATS + """
SELECT clip_id, frame_index, round((p - c) / (s + 1.0), 6) AS contrast_temporal, round((p - c) / (s + 0.001), 6) AS contrast_integrity,
       round(p / (c + 1.0), 6) AS ratio_recompression, round(p / (c + 0.001), 6) AS ratio_frequency
FROM m JOIN d USING (frame_index)
""")
def tile_contrast(spark, sf_dir):
    t = F.col("tiles")
    return frames(spark, sf_dir).select(
        "clip_id", "frame_index",
        F.round(T.contrast(t, 1.0), 6).alias("contrast_temporal"), F.round(T.contrast(t, 1e-3), 6).alias("contrast_integrity"),
        F.round(T.ratio(t, 1.0), 6).alias("ratio_recompression"), F.round(T.ratio(t, 1e-3), 6).alias("ratio_frequency"),
    )


@query(_STATS + """, z AS (
  SELECT frame_index, tile, (v - c) / (s + 0.00001) AS z, v, row_number() OVER (PARTITION BY frame_index ORDER BY v DESC, tile) AS k
  FROM tiles JOIN m USING (frame_index) JOIN d USING (frame_index)
)
SELECT frame_index, round(greatest(0.0, avg(z) FILTER (WHERE k <= 6)), 6) AS hotspot, CAST(max(tile) FILTER (WHERE k = 1) AS INTEGER) AS hot_tile FROM z GROUP BY frame_index
""")
def tile_hotspot(spark, sf_dir):
    return frames(spark, sf_dir).select("frame_index", F.round(T.hotspot(F.col("tiles")), 6).alias("hotspot"), T.hottest(F.col("tiles")).alias("hot_tile"))


@query("WITH " + FRAME_SQL + """, k AS (SELECT *, row_number() OVER (PARTITION BY frame_index ORDER BY v DESC, tile) AS k FROM tiles),
m AS (SELECT frame_index, quantile_cont(v, 0.5) AS c, quantile_cont(v, 0.9) AS p FROM k WHERE k > 1 GROUP BY frame_index)
SELECT frame_index, round((any_value(p) - any_value(c)) / (quantile_cont(abs(v - c), 0.5) + 0.001), 6) AS contrast
FROM k JOIN m USING (frame_index) WHERE k > 1 GROUP BY frame_index
""")
def leave_one_out_tile(spark, sf_dir):
    left = frames(spark, sf_dir).select("frame_index", T.without_hottest(F.col("tiles")).alias("left"))
    return left.select("frame_index", F.round(T.contrast(F.col("left"), 1e-3), 6).alias("contrast"))


@query("WITH " + FRAME_SQL + """
SELECT frame_index, CAST((tile // 8) // 4 * 2 + (tile % 8) // 4 AS INTEGER) AS block, round(avg(v), 6) AS mean FROM tiles GROUP BY ALL
""")
def tile_means(spark, sf_dir):
    means = T.block_means(F.col("tiles"), 8, 2, 2)
    return frames(spark, sf_dir).select("frame_index", F.posexplode(means).alias("block", "mean")).withColumn("mean", F.round("mean", 6))


@query("WITH " + FRAME_SQL + """, g AS (
  SELECT frame_index, v, CASE WHEN tile // 8 < 2 THEN 0 WHEN tile // 8 < 5 THEN 1 ELSE 2 END AS i,
         CASE WHEN tile % 8 < 2 THEN 0 WHEN tile % 8 < 5 THEN 1 ELSE 2 END AS j FROM tiles
)
SELECT frame_index, CAST(i * 3 + j AS INTEGER) AS block, round(avg(v), 6) AS mean FROM g GROUP BY ALL
""")
def tile_means_proportional(spark, sf_dir):
    means = T.proportional_means(F.col("tiles"), 8, 3, 3)
    return frames(spark, sf_dir).select("frame_index", F.posexplode(means).alias("block", "mean")).withColumn("mean", F.round("mean", 6))


@query("WITH " + FRAME_SQL + """, q AS (
  SELECT frame_index, (tile // 8) // 2 AS y, (tile % 8) // 2 AS x,
         sum(v) FILTER (WHERE (tile // 8) % 2 = 0 AND tile % 2 = 0) AS a, sum(v) FILTER (WHERE (tile // 8) % 2 = 0 AND tile % 2 = 1) AS b,
         sum(v) FILTER (WHERE (tile // 8) % 2 = 1 AND tile % 2 = 0) AS c, sum(v) FILTER (WHERE (tile // 8) % 2 = 1 AND tile % 2 = 1) AS d
  FROM tiles GROUP BY ALL
), e AS (
  SELECT frame_index, avg(abs(a + b + c + d)) / 2 AS ll, avg(abs(a + b - c - d)) / 2 AS lh, avg(abs(a - b + c - d)) / 2 AS hl, avg(abs(a - b - c + d)) / 2 AS hh
  FROM q GROUP BY frame_index
)
SELECT frame_index, round(ll / (ll + 1e-6), 6) AS ll, round(lh / (ll + 1e-6), 6) AS lh, round(hl / (ll + 1e-6), 6) AS hl, round(hh / (ll + 1e-6), 6) AS hh FROM e
""")
def haar_energy(spark, sf_dir):
    bands = T.haar(F.col("tiles"), 8)
    e = frames(spark, sf_dir).select("frame_index", *(T.mean_abs(b).alias(n) for n, b in bands.items()))
    return e.select("frame_index", *(F.round(F.col(n) / (F.col("ll") + 1e-6), 6).alias(n) for n in bands))


@query("WITH " + FRAME_SQL + """, s AS (SELECT frame_index, clip_id, pos, tile, v / sum(v) OVER (PARTITION BY frame_index) AS h FROM tiles)
SELECT b.frame_index, round(sqrt(greatest(0.0, 1 - sum(sqrt(a.h * b.h)))), 6) AS distance
FROM s a JOIN s b ON a.clip_id = b.clip_id AND b.pos = a.pos + 1 AND a.tile = b.tile GROUP BY b.frame_index
""")
def histogram_distance(spark, sf_dir):
    total = F.aggregate("tiles", F.lit(0.0), lambda s, v: s + v)
    rows = frames(spark, sf_dir).withColumn("total", total).withColumn("h", F.transform("tiles", lambda v: v / F.col("total")))
    both = S.pairs(rows, ["clip_id"], "pos", "h").where(F.col("previous").isNotNull())
    return both.select("frame_index", F.round(T.histogram_distance(F.col("previous"), F.col("h")), 6).alias("distance"))


@query("WITH " + SPECTRA_SQL + "SELECT clip_id, pos, round(high, 6) AS high_ratio, round(dct, 6) AS dct_energy, round(block, 6) AS blockiness, round(noise, 6) AS noise_sigma FROM sp JOIN dc USING (clip_id, pos) JOIN bl USING (clip_id, pos) JOIN ns USING (clip_id, pos)")
def spectral_kernels(spark, sf_dir):
    """High-frequency ratio, DCT energy, blockiness and noise of mosaic frames, in Arrow batches."""
    import numpy as np

    kinds = {"high_ratio": kernels.radial_ratio, "dct_energy": kernels.dct_energy, "blockiness": kernels.blockiness, "noise_sigma": lambda f: float(np.std(kernels.high_pass(f, 1.2)) / 255)}
    made = mosaics(spark, sf_dir)
    return made.select("clip_id", "pos", *(F.round(kernels.frame_udf(f, 24)(F.col("pixels")), 6).alias(n) for n, f in kinds.items()))


#: SQL for windows of eight samples (value / 500, at a rate of 8) under a Hann window: sw (clip_id, slot, rms, centroid, clipping).
SOUND_SQL = SIGNAL_SQL + """, sm AS (SELECT clip_id, pos // 8 AS slot, pos % 8 AS i, value / 500 AS s FROM sig),
wh AS (SELECT clip_id, slot FROM sm GROUP BY clip_id, slot HAVING count(*) = 8),
am AS (
  SELECT clip_id, slot, k, sqrt(power(sum(s * h * cos(2 * pi() * k * i / 8)), 2) + power(sum(s * h * sin(2 * pi() * k * i / 8)), 2)) AS a
  FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * i / 7) AS h FROM sm JOIN wh USING (clip_id, slot)), (SELECT unnest(range(5)) AS k) GROUP BY ALL
), sw AS (
  SELECT clip_id, slot, any_value(rms) AS rms, sum(k * a) / (sum(a) + 1e-9) / 8 AS centroid, any_value(clipping) AS clipping
  FROM am JOIN (SELECT clip_id, slot, sqrt(avg(s * s) + 1e-12) AS rms, avg(CASE WHEN abs(s) >= 0.995 THEN 1.0::DOUBLE ELSE 0 END) AS clipping FROM sm JOIN wh USING (clip_id, slot) GROUP BY ALL) USING (clip_id, slot)
  GROUP BY clip_id, slot
)"""


@query("WITH " + SOUND_SQL + " SELECT clip_id, slot, round(rms, 6) AS rms, round(centroid, 6) AS centroid, round(clipping, 6) AS clipping FROM sw")
def sound_windows(spark, sf_dir):
    """Loudness, spectral centroid and clipping of windows of eight samples."""
    slot = F.floor(F.col("pos") / 8).cast("long")
    rows = signals(spark, sf_dir).groupBy("clip_id", slot.alias("slot")).agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("s"))
    whole = rows.where(F.size("s") == 8).select("clip_id", "slot", F.transform("s", lambda x: x["value"] / 500).alias("samples"))
    out = whole.withColumn("x", kernels.sound_udf(8.0)(F.col("samples")))
    return out.select("clip_id", "slot", *(F.round(F.get("x", F.lit(k)), 6).alias(n) for k, n in enumerate(("rms", "centroid", "clipping"))))
