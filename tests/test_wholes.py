"""Running sums over ranges, forced buckets, evidence views, WAV files, fusion by other keys."""

import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.operators import evaluate as E
from palisade.operators import fusion
from palisade.sources import files


def test_running_sums(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("n")).repartition(7)
    rows = E.running(df, ["k"], "n").orderBy("k").collect()
    total = 0
    for r in rows:
        assert r.n_before == total
        total += r.n
    assert E.running(df.limit(0), ["k"], "n").count() == 0


def test_rank_metrics_with_ties(spark):
    rng = np.random.default_rng(4)
    rows = [(f"r{k:03}", "positive" if p else "negative", float(s), int(g)) for k, (p, s, g) in enumerate(zip(rng.integers(0, 2, 300), rng.integers(0, 12, 300) / 12, rng.integers(0, 2, 300)))]
    df = spark.createDataFrame(rows, "name string, expected string, score double, g int").repartition(5)
    for keys in ([], ["g"]):
        for r in E.rank_metrics(df, keys).collect():
            mine = sorted((x for x in rows if not keys or x[3] == r.g), key=lambda x: (-x[2], x[0]))
            hits = [k for k, x in enumerate(mine, 1) if x[1] == "positive"]
            assert r.average_precision == pytest.approx(np.mean([(n + 1) / k for n, k in enumerate(hits)]), abs=1e-6)
            plus, minus = ([x[2] for x in mine if x[1] == e] for e in ("positive", "negative"))
            assert r.concordant == sum(a > b for a in plus for b in minus) and r.tied == sum(a == b for a in plus for b in minus)


def test_forced_metrics(spark):
    rows = [("positive", 0.9), ("positive", 0.1), ("negative", 0.5), ("negative", 0.2), (None, 0.7), ("positive", None), ("negative", float("nan"))]
    r = E.forced_metrics(spark.createDataFrame(rows, "expected string, score double"), 0.5).first()
    assert (r.true_positive, r.false_negative, r.false_positive, r.true_negative, r.unscored) == (1, 1, 1, 1, 3)
    assert (r.coverage, r.sensitivity, r.specificity) == (pytest.approx(4 / 6, abs=1e-6), 0.5, 0.5)


def test_evidence_view(spark):
    fused = spark.createDataFrame([(1, "all", 0.5, "a"), (1, "legacy", 0.4, "b")], "clip_id long, evidence_set string, score double, label string")
    directional = spark.createDataFrame([(1, 0.3)], "clip_id long, score double")
    assert [E.evidence_view(fused, directional, s).first().score for s in ("all", "legacy", "directional")] == [0.5, 0.4, 0.3]
    with pytest.raises(ValueError):
        E.evidence_view(fused, directional, "other")


def test_wav(spark, tmp_path):
    values = [0, 16384, -32768, 32767, 100, -100]
    for name, width, channels in (("a", 2, 1), ("b", 2, 2), ("c", 1, 1), ("d", 3, 1)):
        with wave.open(f"{tmp_path}/{name}.wav", "wb") as f:
            f.setnchannels(channels)
            f.setsampwidth(width)
            f.setframerate(4)
            f.writeframes(struct.pack("<6h", *values) if width == 2 else bytes([128, 255, 0]) * 2)
    (tmp_path / "e.wav").write_bytes(b"no wav")
    got = {r.path[-5]: r for r in files.wav(spark, str(tmp_path), 1.0).collect()}
    assert got["a"].samples == pytest.approx([v / 32768 for v in values[:4]]) and got["a"].rate == 4
    assert got["b"].samples == pytest.approx([(a + b) / 65536 for a, b in zip(values[::2], values[1::2])])
    assert got["c"].samples == pytest.approx([0, 127 / 128, -1, 0])
    assert [got[k].status for k in "abcde"] == ["ok", "ok", "ok", "unavailable", "unavailable"]


def test_fusion_by_window_is_fusion_by_clip(spark):
    rows = [(c, w, b, k, "ok", (c * 3 + w * 5 + k * 2) % 10 / 10, False, None, None, None, True) for c in range(4) for w in (1, 2) for k, b in enumerate(("temporal", "frequency", "face", "audio"))]
    kind = "clip_id long, cell long, branch string, branch_order int, status string, score double, has_confidence boolean, confidence_raw string, coverage_raw string, observed_raw string, fusion_eligible boolean"
    df = spark.createDataFrame(rows, kind)
    of = df.select("clip_id", "cell").distinct().withColumns({"quality_confounder": F.lit(False), "detection_frames": F.lit(9.0)})
    whole = sorted(fusion.fuse(df, of, ("clip_id", "cell")).select("clip_id", "cell", "evidence_set", "score", "label").collect())
    one = (F.col("clip_id") * 10 + F.col("cell")).alias("clip_id")
    flat = fusion.fuse(df.select(one, *df.columns[2:]), of.select(one, "quality_confounder", "detection_frames"))
    apart = sorted(flat.select(F.floor(F.col("clip_id") / 10), F.col("clip_id") % 10, "evidence_set", "score", "label").collect())
    assert [tuple(r) for r in whole] == [tuple(r) for r in apart]
