"""The driver's tables seen as media evidence: stand-ins that exercise operators, no more than that.

events: a clip is a user, frames go by (ts, event_id), the signal is value. embeddings: a clip is a label,
frames go by vec_id, a frame is 8 x 8 tiles. documents: a report is a document, labels hold its truth.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.session import table

#: Which branch an event type stands for in even and in odd hours.
BRANCH_OF = {
    ("click", 0): "temporal", ("click", 1): "integrity", ("error", 0): "recompression", ("error", 1): "frequency",
    ("purchase", 0): "codec", ("purchase", 1): "face", ("signup", 0): "spatial", ("signup", 1): "periodicity",
    ("view", 0): "audio", ("view", 1): "wavelet",
}

#: SQL for the frames of clips: clip_id, pos from 0, value, event_type, seconds.
SIGNAL_SQL = """
sig AS (
  SELECT user_id AS clip_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
         value, event_type, ts, epoch_us(ts) / 1000000.0::DOUBLE AS seconds
  FROM events
)"""

#: SQL for the tiles of frames: clip_id, frame_index, pos from 0, tile, v.
FRAME_SQL = """
frames AS (
  SELECT label AS clip_id, vec_id AS frame_index,
         row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos,
         list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)) * 255) AS tiles
  FROM embeddings
), tiles AS (
  SELECT clip_id, frame_index, pos, unnest(range(64)) AS tile, unnest(tiles) AS v FROM frames
)"""

#: SQL for branch results: as branch_results() below.
BRANCH_SQL = """
dim(event_type, half, branch, branch_order) AS (
  VALUES ('click', 0, 'temporal', 0), ('error', 0, 'recompression', 1), ('error', 1, 'frequency', 2),
         ('purchase', 1, 'face', 3), ('signup', 0, 'spatial', 4), ('click', 1, 'integrity', 5),
         ('signup', 1, 'periodicity', 6), ('view', 1, 'wavelet', 7), ('purchase', 0, 'codec', 8), ('view', 0, 'audio', 9)
), br AS (
  SELECT user_id AS clip_id, branch, branch_order,
         CASE WHEN count(*) >= 2 THEN 'ok' ELSE 'unavailable' END AS status,
         round(quantile_cont(value, 0.5) / (quantile_cont(value, 0.9) + 0.000001), 3) AS score,
         user_id % 11 <> branch_order AS has_confidence,
         CASE WHEN user_id % 13 = branch_order THEN 'bad' WHEN user_id % 17 = branch_order THEN NULL
              ELSE CAST(round(least(1.0, count(*) / 8.0::DOUBLE), 6) AS VARCHAR) END AS confidence_raw,
         CASE WHEN user_id % 19 = branch_order THEN 'x' ELSE '1.0' END AS coverage_raw,
         CASE WHEN user_id % 3 = 0 THEN CAST(count(*) AS VARCHAR) END AS observed_raw,
         NOT (user_id % 23 = branch_order) AS fusion_eligible
  FROM events JOIN dim ON dim.event_type = events.event_type AND dim.half = hour(ts) % 2
  GROUP BY user_id, branch, branch_order
), clips AS (
  SELECT user_id AS clip_id, user_id % 5 = 0 AS quality_confounder,
         CASE WHEN user_id % 4 = 0 THEN 0.0 ELSE CAST(count(*) FILTER (WHERE event_type = 'purchase') AS DOUBLE) END AS detection_frames,
         CASE WHEN user_id % 7 = 0 THEN NULL ELSE 24.0::DOUBLE END AS fps,
         count(*) AS frame_count
  FROM events GROUP BY user_id
)"""

ORDER = ("temporal", "recompression", "frequency", "face", "spatial", "integrity", "periodicity", "wavelet", "codec", "audio")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, pos, value, event_type, ts, seconds."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("clip_id"),
        (F.row_number().over(order) - 1).alias("pos"),
        "value",
        "event_type",
        "ts",
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, frame_index, pos, tiles (64 doubles)."""
    order = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("clip_id"),
        F.col("vec_id").alias("frame_index"),
        (F.row_number().over(order) - 1).alias("pos"),
        F.transform("embedding", lambda x: F.abs(x.cast("double")) * 255).alias("tiles"),
    )


def _dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, h, b, ORDER.index(b)) for (t, h), b in BRANCH_OF.items()], "event_type string, half int, branch string, branch_order int")


def _event_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("half", F.hour("ts") % 2)
    return events.join(F.broadcast(_dim(spark)), ["event_type", "half"])


def branch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each clip and branch, with confidence, coverage and counts as a report would have them:
    missing, null or malformed for some."""
    return graded(_event_branches(spark, sf_dir).withColumnRenamed("user_id", "clip_id"), "clip_id")


def window_branches(spark: SparkSession, sampled: DataFrame) -> DataFrame:
    """branch_results of each window's sample (clip_id, cell, ts, value, event_type)."""
    return graded(sampled.withColumn("half", F.hour("ts") % 2).join(F.broadcast(_dim(spark)), ["event_type", "half"]), "clip_id", "cell")


def graded(rows: DataFrame, *keys: str) -> DataFrame:
    clip, order = F.col("clip_id"), F.col("branch_order")
    grouped = rows.groupBy(*keys, "branch", "branch_order").agg(
        F.count("*").alias("n"), F.percentile("value", F.lit(0.5)).alias("mid"), F.percentile("value", F.lit(0.9)).alias("high")
    )
    return grouped.select(
        *keys,
        "branch",
        "branch_order",
        F.when(F.col("n") >= 2, "ok").otherwise("unavailable").alias("status"),
        F.round(F.col("mid") / (F.col("high") + 0.000001), 3).alias("score"),
        (clip % 11 != order).alias("has_confidence"),
        F.when(clip % 13 == order, "bad").when(clip % 17 == order, None).otherwise(F.round(F.least(F.lit(1.0), F.col("n") / 8.0), 6).cast("string")).alias("confidence_raw"),
        F.when(clip % 19 == order, "x").otherwise("1.0").alias("coverage_raw"),
        F.when(clip % 3 == 0, F.col("n").cast("string")).alias("observed_raw"),
        (clip % 23 != order).alias("fusion_eligible"),
    )


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, quality_confounder, detection_frames, fps, frame_count."""
    clip = F.col("user_id")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("frame_count"), F.count_if(F.col("event_type") == "purchase").alias("faces")).select(
        clip.alias("clip_id"),
        (clip % 5 == 0).alias("quality_confounder"),
        F.when(clip % 4 == 0, 0.0).otherwise(F.col("faces").cast("double")).alias("detection_frames"),
        F.when(clip % 7 == 0, None).otherwise(24.0).cast("double").alias("fps"),
        "frame_count",
    )


def mosaics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, pos, pixels: grey frames of 16 x 24, row by row, of six rows of `embeddings` in turn (of a label, by vec_id),
    two by three; where a clip's last frame has fewer, it is dark."""
    slot = F.floor(F.col("pos") / 6).cast("long")
    part = F.struct((F.col("pos") % 6).cast("int").alias("k"), "tiles")
    one = frames(spark, sf_dir).groupBy("clip_id", slot.alias("slot")).agg(F.map_from_entries(F.collect_list(part)).alias("parts"))

    def line(y: int, x: int):
        own = F.col("parts")[F.lit(y // 8 * 3 + x)]
        dark = F.array_repeat(F.lit(0.0), 8)
        return F.coalesce(F.slice(own, y % 8 * 8 + 1, 8), dark)

    return one.select("clip_id", F.col("slot").alias("pos"), F.concat(*(line(y, x) for y in range(16) for x in range(3))).alias("pixels"))


#: SQL for mosaics: px (clip_id, pos, y, x, v).
MOSAIC_SQL = FRAME_SQL + """, gr AS (
  SELECT clip_id, pos, y, x FROM (SELECT DISTINCT clip_id, pos // 6 AS pos FROM frames), (SELECT unnest(range(16)) AS y), (SELECT unnest(range(24)) AS x)
), px AS (
  SELECT gr.clip_id, gr.pos, y, x, coalesce(v, 0) AS v
  FROM gr LEFT JOIN (SELECT clip_id, pos // 6 AS pos, (pos % 6) // 3 * 8 + tile // 8 AS y, (pos % 6) % 3 * 8 + tile % 8 AS x, v FROM tiles) USING (clip_id, pos, y, x)
)"""

#: SQL on mosaics: sp (radial ratio high), dc (dct), bl (block), ns (noise sigma) and rt (ratio), by clip_id and pos.
SPECTRA_SQL = MOSAIC_SQL + """, mn AS (SELECT clip_id, pos, avg(v) AS m FROM px GROUP BY ALL),
fr AS (SELECT unnest(range(384)) // 24 AS u, unnest(range(384)) % 24 AS w),
ft AS (
  SELECT clip_id, pos, u, w, sqrt(power(sum((v - m) * cos(2 * pi() * (u * y / 16.0::DOUBLE + w * x / 24.0::DOUBLE))), 2) + power(sum((v - m) * sin(2 * pi() * (u * y / 16.0::DOUBLE + w * x / 24.0::DOUBLE))), 2)) AS f
  FROM px JOIN mn USING (clip_id, pos), fr GROUP BY ALL
), sp AS (
  SELECT clip_id, pos, avg(f) FILTER (WHERE sqrt(power((CASE WHEN u < 8 THEN u ELSE u - 16 END) / 8.0::DOUBLE, 2) + power((CASE WHEN w < 12 THEN w ELSE w - 24 END) / 12.0::DOUBLE, 2)) > 0.55) / (avg(f) + 1e-9) AS high
  FROM ft GROUP BY clip_id, pos
), cb AS (
  SELECT clip_id, pos, y // 8 AS jy, x // 8 AS jx, c.u, c.w, abs(sum(v * cos(pi() * (2 * (y % 8) + 1) * c.u / 16) * cos(pi() * (2 * (x % 8) + 1) * c.w / 16)) / 4) AS a
  FROM px, (SELECT u, w FROM (SELECT unnest(range(2, 8)) AS u), (SELECT unnest(range(2, 8)) AS w)) c GROUP BY ALL
), dc AS (SELECT clip_id, pos, quantile_cont(a, 0.5) AS dct FROM (SELECT clip_id, pos, jy, jx, avg(a) AS a FROM cb GROUP BY ALL) GROUP BY clip_id, pos),
gx AS (SELECT a.clip_id, a.pos, a.x AS k, abs(b.v - a.v) AS d FROM px a JOIN px b ON a.clip_id = b.clip_id AND a.pos = b.pos AND a.y = b.y AND b.x = a.x + 1),
gy AS (SELECT a.clip_id, a.pos, a.y AS k, abs(b.v - a.v) AS d FROM px a JOIN px b ON a.clip_id = b.clip_id AND a.pos = b.pos AND a.x = b.x AND b.y = a.y + 1),
ex AS (SELECT clip_id, pos, avg(d) FILTER (WHERE k % 8 = 7) AS e, avg(d) FILTER (WHERE k % 8 = 3) AS i FROM gx GROUP BY clip_id, pos),
ey AS (SELECT clip_id, pos, avg(d) FILTER (WHERE k % 8 = 7) AS e, avg(d) FILTER (WHERE k % 8 = 3) AS i FROM gy GROUP BY clip_id, pos),
bl AS (SELECT clip_id, pos, (ex.e + ey.e) / (ex.i + ey.i + 1e-6) AS block FROM ex JOIN ey USING (clip_id, pos)),
ta AS (SELECT t, exp(-t * t / (2 * 1.2::DOUBLE * 1.2::DOUBLE)) / sum(exp(-t * t / (2 * 1.2::DOUBLE * 1.2::DOUBLE))) OVER () AS g FROM (SELECT unnest(range(-5, 6)) AS t)),
b1 AS (
  SELECT p.clip_id, p.pos, p.y, p.x, sum(s.v * g) AS v FROM px p, ta, px s WHERE s.clip_id = p.clip_id AND s.pos = p.pos AND s.x = p.x
   AND s.y = CASE WHEN p.y + t < 0 THEN -(p.y + t) WHEN p.y + t > 15 THEN 30 - (p.y + t) ELSE p.y + t END GROUP BY ALL
), b2 AS (
  SELECT p.clip_id, p.pos, p.y, p.x, sum(s.v * g) AS v FROM b1 p, ta, b1 s WHERE s.clip_id = p.clip_id AND s.pos = p.pos AND s.y = p.y
   AND s.x = CASE WHEN p.x + t < 0 THEN -(p.x + t) WHEN p.x + t > 23 THEN 46 - (p.x + t) ELSE p.x + t END GROUP BY ALL
), hp AS (SELECT clip_id, pos, y, x, px.v - b2.v AS r FROM px JOIN b2 USING (clip_id, pos, y, x)),
ns AS (SELECT clip_id, pos, stddev_pop(r) / 255 AS noise FROM hp GROUP BY clip_id, pos),
tl AS (SELECT clip_id, pos, y // 2 AS ty, x // 3 AS tx, avg(abs(r)) AS r FROM hp GROUP BY ALL),
rt AS (SELECT clip_id, pos, quantile_cont(r, 0.9) / (quantile_cont(r, 0.5) + 1e-3) AS ratio FROM tl GROUP BY clip_id, pos)
"""

#: Frames of a pixel clip; their size.
CLIP, HEIGHT, WIDTH = 24, 96, 160


@lru_cache(CLIP)
def _texture(pos: int) -> np.ndarray:
    y, x = np.mgrid[:HEIGHT, :WIDTH]
    return 90 + 40 * np.sin((x - 2 * pos) / 5.0) * np.cos((y + pos) / 7.0)


def pixel_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, pos, frame_index, height, width, pixels: colour frames drawn from rows of `embeddings`. A clip is CLIP ids in
    turn, so it is bounded at any size of the table. A frame has the row's 64 values as soft light over a texture
    that drifts with pos, and a skin-coloured box whose place and sides follow the row's first values."""
    import pyarrow as pa

    from palisade.functions import vision
    from palisade.session import PIXEL_ROWS, bounded, roomy

    bounded(spark)

    def draw(vector: list[float], pos: int) -> bytes:
        v = np.abs(np.nan_to_num(np.array(vector[:64] + [0.0] * (64 - len(vector)), dtype=np.float64)))
        light = vision.linear_resize(v.reshape(8, 8) * 60, HEIGHT, WIDTH)
        out = np.clip((_texture(pos) + light)[..., None] * np.array([1.0, 0.9, 0.8]), 0, 255)
        h, w = 26 + int(40 * v[0]) % 20, 26 + int(40 * v[1]) % 20
        top, left = 10 + (pos + int(20 * v[2])) % 30, 12 + (3 * pos + int(20 * v[3])) % 90
        out[top : top + h, left : left + w] = (90, 130, 200)
        return out.astype(np.uint8).tobytes()

    def run(batches):
        # a row is drawn to two hundred times its bytes, so batches are cut before
        for whole in batches:
            for k in range(0, whole.num_rows, PIXEL_ROWS):
                batch = whole.slice(k, PIXEL_ROWS)
                pos = batch.column("pos").to_pylist()
                pixels = [None if e is None else draw([0.0 if x is None else x for x in e], p) for e, p in zip(batch.column("embedding").to_pylist(), pos)]
                yield pa.RecordBatch.from_arrays([batch.column("clip_id"), batch.column("pos"), pa.array(pixels, pa.binary())], names=["clip_id", "pos", "pixels"])

    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / CLIP).alias("clip_id"), (F.col("vec_id") % CLIP).alias("pos"), "embedding")
    # rows are few bytes and much work, so they are dealt over a stated number of partitions however few the table's files are
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "clip_id")
    drawn = dealt.mapInArrow(roomy(run), "clip_id long, pos long, pixels binary")
    return drawn.select("clip_id", "pos", (F.col("pos") * 2).alias("frame_index"), F.lit(HEIGHT).alias("height"), F.lit(WIDTH).alias("width"), "pixels")
