"""Files as rows: provenance, report JSON in several encodings, probe JSON, synthetic clips, and sinks."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import robust as R

#: Bits per pixel of the quality tiers.
LOW_BITS, MODERATE_BITS = 0.035, 0.12

FRAME_PROBE = "struct<frames: array<struct<key_frame: string, best_effort_timestamp_time: string, pict_type: string>>>"
STREAM_PROBE = "struct<streams: array<struct<codec_name: string, pix_fmt: string, bit_rate: string, color_range: string>>>"


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """path, size_bytes, container, sha256 of the files under a path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("size_bytes"), suffix(F.col("path")).alias("container"), F.sha2("content", 256).alias("sha256"))


def suffix(path: Column) -> Column:
    """The last suffix of a path in lower case, empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def duration(frames: Column, fps: Column) -> Column:
    return F.when((frames > 0) & (fps > 0), frames / fps)


def fourcc(code: Column) -> Column:
    """The four characters of a codec's code number."""
    return F.concat(*(F.chr(F.shiftright(code, 8 * k).bitwiseAND(F.lit(255))) for k in range(4)))


def quality(bits: Column, frames: Column, pixels: Column) -> tuple[Column, Column, Column]:
    """Bits per pixel, tier and whether compression confounds; unknown counts as confounded."""
    each = R.finite(F.try_divide(bits, F.nullif(frames * pixels, F.lit(0))))
    tier = F.when(each.isNull(), "unknown").when(each < LOW_BITS, "low").when(each < MODERATE_BITS, "moderate").otherwise("high")
    return each, tier, each.isNull() | (each < MODERATE_BITS)


def reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """path and report of JSON files, in UTF-8 with or without a byte order mark, or UTF-16 by its mark. A report
    that is no JSON is null."""
    raw = F.col("content")
    mark = F.hex(F.substring(raw, 1, 2))
    text = (
        F.when(mark.isin("FFFE", "FEFF"), F.decode(raw, "UTF-16"))
        .when(F.hex(F.substring(raw, 1, 3)) == "EFBBBF", F.decode(F.substring(raw, 4, 2**31 - 1), "UTF-8"))
        .otherwise(F.decode(raw, "UTF-8"))
    )
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.from_json(text, schema).alias("report"))


def frame_probe(json: Column) -> Column:
    """Array of structs i, key, seconds from a probe's frame list; null if it has fewer than eight."""
    found = F.from_json(json, FRAME_PROBE)["frames"]
    rows = F.transform(
        found,
        lambda f, i: F.struct(i.alias("i"), (f["key_frame"] == "1").alias("key"), R.finite(f["best_effort_timestamp_time"].try_cast("double")).alias("seconds")),
    )
    return F.when(F.size(found) >= 8, rows)


def stream_probe(json: Column) -> Column:
    """Struct codec_name, pix_fmt, bit_rate, color_range of the first stream of a probe's list; null where there is
    none or the text is no JSON."""
    return F.get(F.from_json(json, STREAM_PROBE)["streams"], F.lit(0))


def wav(spark: SparkSession, path: str, max_seconds: float = 60.0) -> DataFrame:
    """path, status (ok or unavailable), reason, rate and samples (mono, -1 to 1) of the WAV files under a path, of 8 or
    16 bits, max_seconds at the most. A file is decoded in the task that reads it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(p, *decode_wav(bytes(c), max_seconds)) for p, c in zip(frame["path"], frame["content"])], columns=["path", "status", "reason", "rate", "samples"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, status string, reason string, rate int, samples array<float>")


def decode_wav(content: bytes, max_seconds: float) -> tuple[str, str | None, int | None, np.ndarray | None]:
    """status, reason, rate, samples of one WAV file."""
    try:
        with wave.open(io.BytesIO(content)) as f:
            rate, width, channels = f.getframerate(), f.getsampwidth(), f.getnchannels()
            raw = f.readframes(int(max_seconds * rate))
    except (wave.Error, EOFError) as e:
        return "unavailable", f"no WAV file: {e}", None, None
    if width not in (1, 2):
        return "unavailable", f"samples of {8 * width} bits", None, None
    x = np.frombuffer(raw[: len(raw) // (width * channels) * width * channels], "<i2" if width == 2 else np.uint8).astype(np.float32)
    x = x / 32768 if width == 2 else (x - 128) / 128
    return "ok", None, rate, x.reshape(-1, channels).mean(axis=1)


def write_reports(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object a line, nulls left out, NaN refused."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    clean = df.withColumns({c: F.when(F.isnan(c), F.raise_error(F.lit(f"NaN in {c}"))).otherwise(F.col(c)) for c in floats}) if floats else df
    clean.write.mode(mode).json(path)


def write_evaluation(sections: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """A folder of JSON lines for each section of an evaluation."""
    for name, rows in sections.items():
        write_reports(rows, f"{path.rstrip('/')}/{name}", mode)


def synthetic_clip(spark: SparkSession, frames: int = 24, width: int = 96, height: int = 64, cut: int = 12, kind: str = "plain") -> DataFrame:
    """frame_index and pixels (grey, row-major) of a box that moves over a ground which steps at a cut.
    "duplicate-burst" repeats frame 4 eight times, "interpolation" makes frames 4 to 6 blends of 3 and 7."""

    def pixels(index: Column) -> Column:
        ground = F.when(index < cut, 40.0).otherwise(120.0)
        left, top = F.pmod(index * 6, F.lit(width - 16)), F.lit((height - 12) // 2)
        return F.transform(
            F.sequence(F.lit(0), F.lit(width * height - 1)),
            lambda p: F.when(
                (F.pmod(p, F.lit(width)) >= left) & (F.pmod(p, F.lit(width)) < left + 16) & (F.floor(p / width) >= top) & (F.floor(p / width) < top + 12), 255.0
            ).otherwise(ground),
        )

    i = F.col("id")
    shown = i
    if kind == "duplicate-burst":
        shown = F.when((i >= 4) & (i < 12), F.lit(4)).otherwise(i)
    rows = spark.range(frames)
    if kind == "interpolation":
        share = (i - 3) / 4.0
        blend = F.zip_with(pixels(F.lit(3)), pixels(F.lit(7)), lambda a, b: a * (1 - share) + b * share)
        return rows.select(i.alias("frame_index"), F.when((i > 3) & (i < 7), blend).otherwise(pixels(i)).alias("pixels"))
    return rows.select(i.alias("frame_index"), pixels(shown).alias("pixels"))
