"""Events of branches, and branches by window."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.operators import analyze, events
from palisade.operators import localize as L


def lists(df):
    return {(r.clip_id, r.metric): r.indices for r in df.collect()}


def test_events_of_branches(spark):
    errors = [0.1, 0.11, 0.12, 0.13, 0.14, 0.12, 0.9, 0.12, None, 0.12]
    pairs = spark.createDataFrame([(1, k, 2 * k, e) for k, e in enumerate(errors)] + [(2, k, k, 0.5) for k in range(9)] + [(3, k, k, [0.1, 9.0][k % 2]) for k in range(5)], "clip_id int, pos int, frame_index int, error double")
    keys = spark.createDataFrame([(1, 0, True), (1, 3, False), (1, 6, True)], "clip_id int, pos int, key boolean")
    found = spark.createDataFrame([(1, 4, [0.5] * 4), (1, 8, None)], "clip_id int, frame_index int, region array<double>")
    distances = [0.1, 0.1, 0.12, 0.5, 0.1, 0.11, 0.34]
    scenes = spark.createDataFrame([(1, k, d) for k, d in enumerate(distances)], "clip_id int, frame_index int, distance double")
    flat = spark.createDataFrame([(1, k, k, [float(v)] * 4) for k, v in enumerate((10, 10, 20, 30, 40, 50, 47.5, 70, 80))], "clip_id int, pos int, frame_index int, signature array<double>")
    out = lists(events.index_lists(events.transitions(pairs), events.key_frames(keys), events.face_observations(found), events.scene_cuts(scenes), events.resampling_events(flat)))
    assert out[1, "abrupt_transition_indices"] == [12] and (2, "abrupt_transition_indices") not in out and (3, "abrupt_transition_indices") not in out
    assert out[1, "keyframe_indices"] == [0, 6] and out[1, "observation_indices"] == [4]
    # by size, and by deviation from the clip's own
    assert out[1, "cut_indices"] == [3, 6] and out[1, "duplicate_residual_indices"] == [1]
    assert events.index_lists(events.scene_cuts(scenes.limit(0))).count() == 0


def test_wavelet_bursts_and_clusters(spark):
    rng = np.random.default_rng(2)
    still = rng.uniform(50, 60, 64)
    rows = [(1, k, k, (still if k != 6 else rng.uniform(0, 255, 64)).tolist()) for k in range(12)]
    df = spark.createDataFrame(rows, "clip_id int, pos int, frame_index int, tiles array<double>")
    bursts = events.wavelet_bursts(df, 8)
    out = lists(events.index_lists(bursts))
    assert out == {(1, "instability_indices"): [6, 7]}
    cut = spark.createDataFrame([(1, 5, 0.9)], "clip_id int, frame_index int, distance double")
    listed = events.index_lists(bursts, events.scene_cuts(cut))
    (one,) = L.clusters(L.events(listed, spark.createDataFrame([(1, 24.0)], "clip_id int, fps double"))).collect()
    assert (one.start_frame, one.end_frame, one.branch_count, one.event_count) == (5, 7, 2, 3)


def test_each_window_has_its_own_sample(spark):
    frames = spark.range(100).select((F.col("id") % 2).cast("int").alias("clip_id"), F.floor(F.col("id") / 2).alias("pos"), F.floor(F.col("id") / 2).alias("frame_index"))
    clips = spark.createDataFrame([(0, 10.0, 50, 5.0), (1, 0.0, 50, 5.0)], "clip_id int, fps double, frame_count int, duration_seconds double")
    cuts = spark.createDataFrame([(0, 25), (0, 3)], "clip_id int, cut int")
    cells, own, inside = analyze.window_samples(frames, clips, [1, 4, 9], [4, 8], cuts)
    assert sorted(tuple(r) for r in cells.collect()) == [(0, 1004), (0, 1008), (0, 4004), (0, 4008)]
    rows = own.orderBy("clip_id", "pos").collect()
    by = {}
    for r in rows:
        by.setdefault(r.clip_id.cell, []).append((r.pos, r.frame_index))
    assert by[1004] == [(0, 20), (1, 23), (2, 26), (3, 29)] and [f for _, f in by[4008]] == [5, 10, 16, 21, 27, 32, 38, 44]
    assert sorted((r.clip_id.cell, r.cut) for r in inside.collect()) == [(1004, 25), (1008, 25), (4004, 25), (4008, 25)]
    with pytest.raises(ValueError):
        analyze.analyze_windows({"codec": ()}, cells, clips)
