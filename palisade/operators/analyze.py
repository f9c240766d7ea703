"""From samples to a score: branches made through their registry, in the form in which reports have them, and fused."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.operators import fusion
from palisade.operators import sequence as S
from palisade.operators import stability
from palisade.operators.branches import REGISTRY
from palisade.session import durable

#: What each branch reports; the rest of its columns are its metrics.
COMMON = ("clip_id", "branch", "status", "score", "confidence")


def shared_sample(frames: DataFrame, most: int) -> DataFrame:
    """At most `most` frames of each clip, evenly spread, with places numbered anew. All branches read this one, so it is
    kept in the shared folder."""
    taken = S.uniform_sample(frames, ["clip_id"], "pos", most)
    return durable(taken.withColumn("pos", F.row_number().over(Window.partitionBy("clip_id").orderBy("pos")) - 1))


def branch_rows(inputs: Mapping[str, Sequence]) -> DataFrame:
    """Rows as fusion takes them, with `metrics` (JSON of what else a branch reports). inputs: by name of a branch, what
    its maker takes. Scores and confidences are rounded to six places, as reports are."""
    out = None
    for name, arguments in inputs.items():
        branch = REGISTRY[name]
        rows = branch.make(*arguments)
        more = [c for c in rows.columns if c not in (*COMMON, "fusion_eligible")]
        eligible = F.col("fusion_eligible") if "fusion_eligible" in rows.columns else F.lit(True)
        one = rows.select(
            "clip_id", "branch", F.lit(branch.order).alias("branch_order"), "status", F.round("score", 6).alias("score"), F.lit(True).alias("has_confidence"),
            F.round("confidence", 6).cast("string").alias("confidence_raw"), F.lit(None).cast("string").alias("coverage_raw"), F.lit(None).cast("string").alias("observed_raw"),
            eligible.alias("fusion_eligible"), (F.to_json(F.struct(*more)) if more else F.lit("{}")).alias("metrics"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def analyze(inputs: Mapping[str, Sequence], clips: DataFrame) -> DataFrame:
    """The fused rows of clips (clip_id, quality_confounder, detection_frames) from their branches' inputs."""
    # a row for each clip and branch: a good place to come to rest between two long plans
    return fusion.fuse(durable(branch_rows(inputs)), clips)


#: Branches of the stream as a whole, which windows leave out.
STREAM = ("codec", "avsync", "audio")


def window_samples(frames: DataFrame, clips: DataFrame, windows: list[int], budgets: list[int], cuts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The cells of clips (clip_id, fps, frame_count, duration_seconds) by window and budget, each cell's own sample of frames
    (clip_id, pos, ...) and the cuts (clip_id, cut) within it, both keyed by clip_id as a struct of clip_id and cell, with places
    numbered anew. Branch makers take them as if each cell were a clip: one shuffle deals all cells' frames, which are
    kept in the shared folder. Pairs are formed anew, as the frame before is another one in each sample."""
    cell = (F.col("window_seconds") * 1000 + F.col("budget")).cast("long").alias("cell")
    key = F.struct("clip_id", cell).alias("clip_id")
    cells = stability.grid(clips, windows, budgets)
    rows = stability.sampled(cells, frames)
    keyed = rows.select(key, F.col("pos").alias("_place"), *(c for c in frames.columns if c not in ("clip_id", "pos")))
    order = Window.partitionBy("clip_id").orderBy("_place")
    own = durable(keyed.withColumn("pos", F.row_number().over(order) - 1).drop("_place"))
    inside = None
    if cuts is not None:
        inside = stability.cuts_within(cells, cuts).where("cut IS NOT NULL").select(key, "cut")
    return cells.select("clip_id", cell), own, inside


def analyze_windows(inputs: Mapping[str, Sequence], cells: DataFrame, clips: DataFrame) -> DataFrame:
    """The fused rows of each cell (clip_id, cell) from its own branches' inputs, as window_samples() keys them; clips:
    clip_id, quality_confounder, detection_frames. Branches of the stream don't go by window."""
    if stream := [n for n in inputs if n in STREAM]:
        raise ValueError(f"branches of the stream: {', '.join(stream)}")
    rows = branch_rows(inputs).withColumn("cell", F.col("clip_id.cell")).withColumn("clip_id", F.col("clip_id.clip_id"))
    return fusion.fuse(durable(rows), cells.join(clips, "clip_id"), ("clip_id", "cell"))
