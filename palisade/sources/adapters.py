"""What needs tools outside Spark: decoders, probes, trained routers. Each says whether it is there; where
its tool is missing its branch is a row of status `unavailable`, never a stand-in value."""

from __future__ import annotations

import importlib.util
import shutil
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Adapter:
    name: str
    branch: str | None
    modules: tuple[str, ...] = ()
    programs: tuple[str, ...] = ()

    def missing(self) -> list[str]:
        return [m for m in self.modules if importlib.util.find_spec(m) is None] + [p for p in self.programs if shutil.which(p) is None]


ADAPTERS = (
    Adapter("video-decode", None, ("cv2",)),
    Adapter("frame-probe", "codec", (), ("ffprobe",)),
    Adapter("stream-probe", "avsync", (), ("ffprobe",)),
    Adapter("audio-decode", "audio", ("soundfile",), ()),
    Adapter("transcode", None, (), ("ffmpeg",)),
    Adapter("router", None, ("torch",)),
)


def availability(spark: SparkSession) -> DataFrame:
    """name, branch, available, missing."""
    rows = [(a.name, a.branch, not a.missing(), a.missing()) for a in ADAPTERS]
    return spark.createDataFrame(rows, "name string, branch string, available boolean, missing array<string>")


def unavailable(clips: DataFrame, adapter: Adapter) -> DataFrame:
    """A branch row of each clip (clip_id) that says that the tool is missing."""
    return clips.select(
        "clip_id", F.lit(adapter.branch).alias("branch"), F.lit("unavailable").alias("status"), F.lit(None).cast("double").alias("score"),
        F.lit(0.0).alias("confidence"), F.lit("not installed: " + ", ".join(adapter.missing())).alias("warning"),
    )
