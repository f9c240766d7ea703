"""Pixel algorithms against loops and known motion, and branches from pixels."""

from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.functions import kernels, vision
from palisade.operators import branches as B
from palisade.operators import pixels as P


def texture(seed=1, h=180, w=240, blur=2.0):
    g = vision.gauss(blur, 6)
    out = vision.correlate(vision.correlate(np.random.default_rng(seed).uniform(0, 255, (h, w)), g, 0), g, 1)
    return (out - out.min()) / np.ptp(out) * 255


def shifted(base, dx, dy, h=120, w=180):
    """A window of base whose contents have moved by (dx, dy)."""
    flow = np.zeros((*base.shape, 2))
    flow[..., 0], flow[..., 1] = 20 - dx, 20 - dy
    return vision.warp(base, flow)[:h, :w]


def flood(mask):
    seen, out = np.zeros(mask.shape, bool), []
    for start in zip(*np.nonzero(mask)):
        if seen[start]:
            continue
        todo, cells = deque([start]), []
        seen[start] = True
        while todo:
            y, x = todo.popleft()
            cells.append((y, x))
            for v in range(max(y - 1, 0), min(y + 2, mask.shape[0])):
                for u in range(max(x - 1, 0), min(x + 2, mask.shape[1])):
                    if mask[v, u] and not seen[v, u]:
                        seen[v, u] = True
                        todo.append((v, u))
        c = np.array(cells)
        out.append((c[:, 1].min(), c[:, 0].min(), np.ptp(c[:, 1]) + 1, np.ptp(c[:, 0]) + 1, len(c), c[:, 1].mean(), c[:, 0].mean()))
    return np.array(out, dtype=float).reshape(-1, 7)


@pytest.mark.parametrize("share", [0.0, 0.2, 0.45, 0.6, 1.0])
def test_regions_are_those_of_a_flood_fill(share):
    mask = np.random.default_rng(3).random((40, 61)) < share
    found = vision.regions(mask)
    mine = np.stack([found[k] for k in ("x", "y", "width", "height", "area", "centre_x", "centre_y")], axis=1)
    assert np.allclose(mine, flood(mask))
    spiral = np.zeros((9, 9), bool)
    spiral[0], spiral[:, 8], spiral[8], spiral[2:, 0], spiral[2, :7], spiral[2:7, 6] = 1, 1, 1, 1, 1, 1
    assert len(vision.regions(spiral)["area"]) == len(flood(spiral)) == 1


def test_morphology():
    mask = np.zeros((20, 20), bool)
    mask[4:12, 4:12], mask[7, 7], mask[16, 3] = True, False, True
    out = vision.cleaned(mask)
    assert not out[16, 3] and vision.eroded(np.ones((5, 5), bool)).all() and vision.dilated(mask)[15:18, 2:5].all()
    loop = np.array([[all(mask[v, u] for v in range(max(y - 1, 0), min(y + 2, 20)) for u in range(max(x - 1, 0), min(x + 2, 20))) for x in range(20)] for y in range(20)])
    assert (vision.eroded(mask) == loop).all()


def test_skin_regions():
    frame = np.full((120, 160, 3), 60, np.uint8)
    assert vision.skin_regions(frame) == (0, None)
    frame[10:40, 20:50] = frame[60:110, 80:120] = (90, 130, 200)
    frame[100:104, 0:70] = (90, 130, 200)  # long and flat
    n, region = vision.skin_regions(frame)
    assert n == 2 and np.allclose(region, [(80 + 119) / 2 / 160, (60 + 109) / 2 / 120, 40 / 160, 50 / 120])
    assert vision.hsv(np.array([[[0, 0, 255], [0, 255, 0], [255, 0, 0], [7, 7, 7]]])).tolist() == [[[0, 255, 255], [60, 255, 255], [120, 255, 255], [0, 0, 7]]]


@pytest.mark.parametrize("move", [(0, 0), (3, 0), (0, -2), (2.5, 1.5), (6, 4)])
def test_flow_and_tracking_of_known_motion(move):
    base = texture()
    a, b = shifted(base, 0, 0), shifted(base, *move)
    inner = (slice(20, -20), slice(20, -20))
    flow = vision.dense_flow(a, b)
    assert np.abs(flow[inner] - move).mean() < 0.1
    assert np.abs(vision.warp(b, flow) - a)[inner].mean() < 3
    points = vision.corners(a)
    there, ok = vision.track(a, b, points)
    central = ok & (points > 25).all(axis=1) & (points < np.array([180, 120]) - 25).all(axis=1)
    assert central.sum() > 10 and np.abs(there - points - move)[central].mean() < 0.1
    assert np.median(vision.round_trips(a, b)) < 0.1


def test_identical_flat_and_lost():
    a = shifted(texture(), 0, 0)
    assert np.abs(vision.dense_flow(a, a)).max() < 1e-6 and vision.round_trips(a, a).max() < 1e-9
    flat = np.full((80, 100), 90.0)
    assert len(vision.corners(flat)) == 0 and len(vision.round_trips(flat, flat)) == 0
    assert not vision.track(flat, flat, np.array([[40.0, 40.0]]))[1].any()
    # contents that leave the frame take their points along
    one = np.zeros((80, 120))
    one[30:40, 100:110] = texture(4, 10, 10, 0.5)
    two = np.zeros((80, 120))
    assert not vision.track(one, two, np.array([[119.0, 1.0]]))[1].any()


def test_corners_keep_apart_and_strongest_first():
    points = vision.corners(texture(6, blur=1.0))
    apart = np.hypot(*(points[:, None] - points[None]).transpose(2, 0, 1)) + np.eye(len(points)) * 99
    assert len(points) == vision.CORNERS and apart.min() >= vision.APART
    square = np.zeros((60, 60))
    square[20:40, 20:40] = 255
    assert {tuple(np.round(p / 20) * 20) for p in vision.corners(square)} == {(20, 20), (20, 40), (40, 20), (40, 40)}


def test_resizing():
    frame = texture(2, 32, 48)
    assert np.allclose(vision.area_resize(frame, 8, 12), frame.reshape(8, 4, 12, 4).mean(axis=(1, 3)))
    fine = np.kron(frame, np.ones((5, 5)))  # 160 x 240 to 24 x 36: cells of 20 / 3 pixels
    exact = np.kron(fine, np.ones((3, 3))).reshape(24, 20, 36, 20).mean(axis=(1, 3))
    assert np.allclose(vision.area_resize(fine, 24, 36), exact)
    assert np.allclose(vision.area_resize(frame, 32, 48), frame) and np.ptp(vision.area_resize(np.full((5, 5), 3.0), 12, 7)) < 1e-12
    colour = np.stack([frame, frame * 0, frame], axis=-1)
    assert np.allclose(vision.area_resize(colour, 8, 12)[..., 2], vision.area_resize(frame, 8, 12))


def test_jpeg_round_trip():
    frame = np.clip(np.stack([texture(k, 50, 70, 3.0) for k in range(3)], axis=-1), 0, 255).astype(np.uint8)
    off = [np.abs(vision.jpeg_round_trip(frame, q).astype(int) - frame).mean() for q in (100, 90, 75, 50, 20, 5)]
    assert off == sorted(off)
    grey = np.repeat(frame[..., :1], 3, axis=2)  # without colour to halve, the best quality loses next to nothing
    assert np.abs(vision.jpeg_round_trip(grey, 100).astype(int) - grey).mean() < 0.5
    assert vision.quantisation(vision.BRIGHTNESS, 50).ravel().tolist() == list(vision.BRIGHTNESS) and (vision.quantisation(vision.COLOUR, 100) == 1).all()
    # a grey block by loops: colour planes are flat there
    block = texture(9, 16, 16, 1.0).astype(np.uint8)
    table = vision.quantisation(vision.BRIGHTNESS, 40)
    want = np.zeros((16, 16))
    c = lambda u, i: np.cos(np.pi * (2 * i + 1) * u / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5)
    for y in (0, 8):
        for x in (0, 8):
            f = block[y : y + 8, x : x + 8] - 128.0
            coded = [[round(sum(f[i, j] * c(u, i) * c(v, j) for i in range(8) for j in range(8)) / table[u, v]) * table[u, v] for v in range(8)] for u in range(8)]
            for i in range(8):
                for j in range(8):
                    want[y + i, x + j] = min(max(round(sum(coded[u][v] * c(u, i) * c(v, j) for u in range(8) for v in range(8)) + 128), 0), 255)
    assert np.abs(vision.jpeg_round_trip(np.stack([block] * 3, axis=-1), 40)[..., 0] - want).max() <= 1


def test_rules_of_kernels_by_loops():
    frame = texture(5, 72, 128, 0.8)
    edge = [np.mean([abs(frame[y + 1, x] - frame[y, x]) for y in range(k, 71, 8) for x in range(128)]) + np.mean([abs(frame[y, x + 1] - frame[y, x]) for y in range(72) for x in range(k, 127, 8)]) for k in (7, 3)]
    assert np.isclose(kernels.blockiness(frame), edge[0] / (edge[1] + 1e-6))
    # dark bars on all sides go; where a picture reaches the border its brightness is the border's too, and a dark frame with
    # one bright box stays whole
    barred = np.zeros((90, 160))
    barred[8:82, 15:145] = 120
    assert kernels.content(barred).min() == 120
    barred[:, 15:145] = 120
    assert kernels.content(barred).min() == 0
    box = np.full((90, 160), 5.0)
    box[20:40, 30:60] = 200
    assert np.isclose(kernels.content(box).mean(), box.mean(), rtol=0.01) and kernels.content(box).shape == (144, 256)
    # what comes back is read where the flow leads
    there, back = np.zeros((40, 40, 2)), np.zeros((40, 40, 2))
    there[:, :20, 0], back[:, 20:, 0] = 20, -20
    assert kernels.occlusion(there, back) == 0.5 and kernels.occlusion(there * 0, back * 0) == 0


def clip(spark, frames, name=1):
    rows = [(name, k, 2 * k, *f.shape[:2], bytearray(f.tobytes())) if f is not None else (name, k, 2 * k, 4, 4, None) for k, f in enumerate(frames)]
    return spark.createDataFrame(rows, "clip_id int, pos int, frame_index int, height int, width int, pixels binary")


def test_branches_from_pixels(spark):
    """A face whose shape flickers is scored, one that keeps its shape is not; still frames are calm; broken ones drop out."""
    base = np.stack([texture(7, 96, 128)] * 3, axis=-1).astype(np.uint8)

    def with_box(k, wide):
        out = base.copy()
        out[20:60, 20 + k : 20 + k + wide] = (90, 130, 200)
        return out

    flicker = clip(spark, [with_box(k, 24 + 24 * (k % 2)) for k in range(14)])
    steady = clip(spark, [with_box(k, 36) for k in range(14)], 2)
    faces = {r.clip_id: r for r in B.face(*P.face_inputs(P.detections(flicker.unionByName(steady).unionByName(clip(spark, [base] * 5, 3))))).collect()}
    assert faces[1].score is not None and faces[2].score is None and faces[3].score is None and faces[1].confidence == 1
    still = clip(spark, [base] * 6 + [None, base], 4).unionByName(clip(spark, [base], 5))
    got = {r.clip_id: r for r in B.temporal(P.temporal_pairs(still, size=(96, 128))).collect()}
    assert got[4].score == 0 and 5 not in got
    rows = P.integrity_pairs(still, (96, 128)).where("clip_id = 4").orderBy("pos").collect()
    assert len(rows) == 8 and rows[0].residual is None and rows[0].dct is not None and rows[1].residual == 0 and rows[6].residual is None
    assert {r.clip_id: r.score for r in B.recompression(P.recompression_frames(still)).collect()}[4] is not None
    assert {r.clip_id: r.score for r in B.frequency(P.frequency_frames(still, (96, 128))).collect()}[5] is None
    scenes = P.scene_pairs(clip(spark, [base, base, base[::-1] // 2 + 100, (base * np.array([1, 0.3, 0.1])).astype(np.uint8)])).orderBy("pos").collect()
    assert scenes[0].distance < 1e-6 and scenes[2].distance > 0.3
    cuts = spark.createDataFrame([(4, 2)], "clip_id int, cut int")
    assert P.temporal_pairs(still.where("clip_id = 4"), cuts, (96, 128)).count() == 5
    assert P.temporal_pairs(still.limit(0), size=(96, 128)).count() == 0
    assert np.isclose(P.detections(steady).where("pos = 3").select(F.get("region", F.lit(2))).first()[0], 36 / 128)


def test_pairs_tracked_together_are_as_each_alone():
    looks = [vision.Look(np.rint(shifted(texture(k // 3), k % 3, 0))) for k in range(6)] + [vision.Look(np.full((120, 180), 9.0))]
    pairs = list(zip(looks, looks[1:]))
    for many, (a, b) in zip(vision.trips(pairs), pairs):
        alone = vision.round_trips(a.image, b.image)
        assert many.shape == alone.shape and np.allclose(many, alone, atol=1e-9)


def test_frames_looked_at_once_give_the_rows_of_each_operator(spark):
    """Barred frames show integrity another picture than temporal; a clip may have both kinds, and broken frames."""
    base = np.stack([texture(8, 96, 128)] * 3, axis=-1).astype(np.uint8)
    barred = np.zeros_like(base)
    barred[14:80, 10:120] = base[14:80, 10:120]
    moved = [np.roll(base, k, axis=1) for k in range(4)]
    frames = clip(spark, [*moved, None, barred, np.roll(barred, 1, axis=0), base]).unionByName(clip(spark, moved[::-1], 2)).unionByName(clip(spark, [barred], 3))
    got = P.evidence(frames, (96, 128), (96, 128), (48, 64))
    assert got["integrity"].where("clip_id = 1 AND pos = 6").first().residual != P.temporal_pairs(frames, size=(96, 128)).where("clip_id = 1 AND pos = 6").first().error
    want = {
        "scene": P.scene_pairs(frames),
        "temporal": P.temporal_pairs(frames, size=(96, 128)),
        "recompression": P.recompression_frames(frames),
        "frequency": P.frequency_frames(frames, (48, 64)),
        "face": P.detections(frames),
        "integrity": P.integrity_pairs(frames, (96, 128)),
    }
    for branch, rows in want.items():
        a, b = (sorted(x.select(*rows.columns).collect(), key=lambda r: (r.clip_id, r.pos)) for x in (got[branch], rows))
        assert len(a) == len(b) > 0, branch
        for x, y in zip(a, b):
            assert all(u == v or isinstance(u, float) and np.isclose(u, v, atol=1e-9) for u, v in zip(x, y)), (branch, x, y)
    assert P.evidence(frames.limit(0), (96, 128), (96, 128))["integrity"].count() == 0


def test_flow_of_frames_that_look_the_same_is_found_once(spark, monkeypatch):
    """Six branches read the pixels six times, and found the same flow twice."""
    from palisade.plans import pixels as plans

    calls, real = [], P.features
    monkeypatch.setattr(P, "features", lambda *a: calls.append(1) or real(*a))
    flows, flow = [], vision.dense_flow
    looks = [vision.Look(np.rint(shifted(texture(5), k, 0))) for k in range(2)]
    monkeypatch.setattr(vision, "dense_flow", lambda *a: flows.append(1) or flow(*a))
    kept, real_followed = {}, P.followed
    monkeypatch.setattr(P, "followed", lambda seen, looks, make, columns, alone: kept.update(make=make, columns=columns) or real_followed(seen, looks, make, columns, alone))
    rows = spark.range(30).selectExpr("id AS vec_id", "transform(sequence(1, 64), x -> float(x + id % 7)) AS embedding")
    monkeypatch.setattr("palisade.plans.standins.table", lambda *a: rows)
    assert plans.pixel_branches(spark, "").count() > 0 and len(calls) == 1
    pair = tuple(looks)
    assert len(kept["make"]([(pair, pair)])[0]) == len(kept["columns"]) and len(flows) == 2


def test_python_works_on_few_frames_at_a_time(spark, tmp_path):
    """Rows of pixels by the thousand in a batch were gigabytes of a worker's memory."""
    import pyarrow.parquet as pq

    from palisade.plans.standins import pixel_frames

    rows = spark.range(3000).selectExpr("id AS vec_id", "transform(sequence(1, 64), x -> float(x + id % 7)) AS embedding", "int(id % 10) AS label")
    rows.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert pq.read_metadata(next((tmp_path / "embeddings.parquet").glob("*.parquet"))).num_rows == 3000

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        most = max(r.n for r in pixel_frames(spark, str(tmp_path)).mapInArrow(sizes, "n long").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert most <= 9 << 20
