"""Queries from pixels to branch rows, on frames drawn from a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.catalogue import query
from palisade.operators import branches as B
from palisade.operators import pixels as P
from palisade.plans.standins import HEIGHT, WIDTH, pixel_frames
from palisade.session import shared_path
from palisade.sources import clips

#: The working size of flow here: the drawn frames' own.
SIZE = (HEIGHT, WIDTH)


def _rounded(df, *names):
    return df.withColumns({c: F.round(c, 6) for c in names})


@query()
def skin_detections(spark, sf_dir):
    """Admissible skin-like regions of each frame, and the largest."""
    found = P.detections(pixel_frames(spark, sf_dir))
    parts = {n: F.round(F.get("region", F.lit(k)), 6) for k, n in enumerate(("centre_x", "centre_y", "width", "height"))}
    return found.select("clip_id", "frame_index", "candidates", *(c.alias(n) for n, c in parts.items()))


@query()
def temporal_pairs(spark, sf_dir):
    """Warp error, tracked corners, local residual and motion of each pair of frames."""
    return _rounded(P.temporal_pairs(pixel_frames(spark, sf_dir), size=SIZE), "error", "flow", "local", "motion")


@query()
def pixel_branches(spark, sf_dir):
    """Six branches from one set of frames, drawn and looked at once."""
    seen = P.evidence(pixel_frames(spark, sf_dir), SIZE, SIZE)
    rows = B.union(
        B.scene(seen["scene"]),
        B.temporal(seen["temporal"]),
        B.recompression(seen["recompression"]),
        B.frequency(seen["frequency"]),
        B.face(*P.face_inputs(seen["face"])),
        B.integrity(seen["integrity"]),
    )
    return _rounded(rows, "score", "confidence")


@query("""
WITH c AS (SELECT vec_id // 24 AS clip, vec_id % 24 AS place, count(*) OVER (PARTITION BY vec_id // 24) AS n FROM embeddings),
p AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY place) - 1 AS i FROM c)
SELECT clip AS clip_id, CAST(i AS INTEGER) AS frame_index, round(i / 24.0::DOUBLE, 6) AS seconds, 46080 AS n_bytes FROM p
WHERE list_contains(list_transform(range(least(5, n)), lambda k: CASE WHEN k = least(5, n) - 1 THEN n - 1 ELSE CAST(floor(k * ((n - 1) / (least(5, n) - 1)::DOUBLE)) AS BIGINT) END), i)
""")
def sampled_clip_frames(spark, sf_dir):
    """Five frames of each clip, sought in clips that are written from drawn frames."""
    folder = shared_path(spark, "clips")
    clips.write(pixel_frames(spark, sf_dir), folder).count()
    clips.register(spark)
    rows = spark.read.format("y4m").option("sample", 5).load(folder)
    clip = F.regexp_extract("path", r"([0-9]+)\.y4m$", 1).cast("long")
    return rows.select(clip.alias("clip_id"), "frame_index", "seconds", F.length("pixels").alias("n_bytes"))
