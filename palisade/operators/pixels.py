"""From decoded frames to the feature rows of the branches that look at pixels.

Frames are rows clip_id, pos, frame_index, height, width, pixels (bytes of blue, green, red, row by row). Features of one
frame are made where the frame is; those of a pair after one shuffle by clip of grey frames at their working size, in whose
order each frame meets the one before it. Nothing gathers a clip's pixels. A frame whose bytes don't fit its size, or that is null, has null features, and so
has a pair with such a frame; branches leave those out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import kernels, tiles as T, vision
from palisade.operators import sequence as S
from palisade.session import PIXEL_ROWS, bounded, durable, roomy

#: Sizes (height, width) at which branches look at frames, quality of the JPEG round trip.
TEMPORAL_SIZE, CONTENT_SIZE, SPECTRUM_SIZE, QUALITY = (180, 320), (144, 256), (144, 256), 75
_ARROW = {"double": pa.float64(), "int": pa.int32(), "long": pa.int64(), "array<double>": pa.list_(pa.float64()), "binary": pa.binary()}
#: Pairs whose corners are tracked together: as many as have so many pixels, up to BLOCK.
BLOCK, BLOCK_PIXELS = 32, 1 << 19
Picture = np.ndarray | None


def pictures(column: pa.Array, height: pa.Array, width: pa.Array) -> Iterator[Picture]:
    for p, h, w in zip(column, height.to_pylist(), width.to_pylist()):
        data = p.as_buffer()
        fits = data is not None and h and w and h > 0 and w > 0 and data.size == h * w * 3
        yield np.frombuffer(data, np.uint8).reshape(h, w, 3) if fits else None


def features(frames: DataFrame, make: Callable[[np.ndarray], tuple], columns: dict[str, str]) -> DataFrame:
    """frames' columns but the picture's, and `columns` (names and types), what make(picture) gives; nulls where it is
    missing."""
    bounded(frames.sparkSession)
    held = [c for c in frames.columns if c not in ("pixels", "height", "width")]
    kinds = [pa.field(n, _ARROW[t]) for n, t in columns.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, PIXEL_ROWS):
                batch = whole.slice(k, PIXEL_ROWS)
                rows = [(None,) * len(kinds) if x is None else make(x) for x in pictures(*(batch.column(c) for c in ("pixels", "height", "width")))]
                out = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in held), *out], names=[*held, *columns])

    kept = ", ".join(f"`{c}` {frames.schema[c].dataType.simpleString()}" for c in held)
    return frames.mapInArrow(roomy(run), kept + ", " + ", ".join(f"{n} {t}" for n, t in columns.items()))


Pair = tuple[vision.Look, vision.Look]


def paired(
    frames: DataFrame, look: Callable[[np.ndarray], np.ndarray], size: tuple[int, int], make: Callable[[list[Pair]], list[tuple]],
    columns: dict[str, str], alone: Callable[[vision.Look], tuple] | None = None,
) -> DataFrame:
    """clip_id, pos, frame_index, before_index (null for a clip's first frame), first, and `columns`: what make(pairs) gives of
    each frame and the one before it, as look(picture) shows them (whole grey values of 0 to 255, of `size`), and alone(frame) of
    first ones. A frame's row comes from one look at it, which both of its pairs share."""
    seen = features(frames.select("clip_id", "pos", "frame_index", "height", "width", "pixels"), lambda f: (look(f).astype(np.uint8).tobytes(),), {"look": "binary"})
    first = None if alone is None else lambda shown: alone(shown[0])
    return followed(seen, {"look": size}, lambda pairs: make([p[0] for p in pairs]), columns, first)


def followed(
    seen: DataFrame, looks: dict[str, tuple[int, int]], make: Callable[[list[tuple[Pair, ...]]], list[tuple]],
    columns: dict[str, str], alone: Callable[[list[vision.Look]], tuple] | None = None,
) -> DataFrame:
    """seen's columns but its looks (bytes of grey values; names and sizes in `looks`), before_index, first, and `columns`: what
    make() gives of each frame's pairs with the one before it, one for each of the looks, and alone() of a first frame's looks.
    A look that is null is the first one again, and then both are one object; where the first is null the frame is missing."""
    # a stated number of partitions: few bytes of pixels are much work, so they aren't to be coalesced by their size
    dealt = seen.repartition(int(seen.sparkSession.conf.get("spark.sql.shuffle.partitions")), "clip_id").sortWithinPartitions("clip_id", "pos")
    kinds = [pa.field("before_index", pa.int64()), pa.field("first", pa.bool_()), *(pa.field(n, _ARROW[t]) for n, t in columns.items())]
    h, w = next(iter(looks.values()))
    none, step = (None,) * len(columns), min(BLOCK, max(1, BLOCK_PIXELS // (h * w)))
    names = [c for c in seen.columns if c not in looks]

    def shown(row: tuple[bytes | None, ...]) -> list[vision.Look] | None:
        if row[0] is None:
            return None
        own = [data and vision.Look(np.frombuffer(data, np.uint8).reshape(size).astype(np.float64)) for data, size in zip(row, looks.values())]
        return [x or own[0] for x in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clip, index, before, begun = None, None, None, False
        for whole in batches:
            for k in range(0, whole.num_rows, step):
                batch = whole.slice(k, step)
                rows, pairs = [], []
                for c, i, *data in zip(*(batch.column(n).to_pylist() for n in ("clip_id", "frame_index", *looks))):
                    own = shown(data)
                    first = not begun or c != clip
                    if first:
                        rows.append([None, True, alone(own) if alone is not None and own is not None else none])
                    else:
                        if before is not None and own is not None:
                            pairs.append((len(rows), tuple(zip(before, own))))
                        rows.append([index, False, none])
                    clip, index, before, begun = c, i, own, True
                for (at, _), made in zip(pairs, make([p for _, p in pairs]) if pairs else []):
                    rows[at][2] = made
                flat = [(a, b, *rest) for a, b, rest in rows]
                held = [batch.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*held, *(pa.array([r[j] for r in flat], f.type) for j, f in enumerate(kinds))], names=[*names, *(f.name for f in kinds)])

    kept = ", ".join(f"`{c}` {seen.schema[c].dataType.simpleString()}" for c in names)
    return dealt.mapInArrow(roomy(run), kept + ", before_index long, first boolean, " + ", ".join(f"{n} {t}" for n, t in columns.items()))


def grey(frame: np.ndarray) -> np.ndarray:
    return np.rint(kernels.gray(frame))


def small(frame: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """A grey frame of whole values at a working size."""
    return np.rint(vision.area_resize(grey(frame), *size))


def tile_means(image: np.ndarray, rows: int = 8, columns: int = 8) -> np.ndarray:
    """Means of equal tiles, what is left over dropped."""
    h, w = image.shape[0] // rows, image.shape[1] // columns
    return image[: h * rows, : w * columns].reshape(rows, h, columns, w).mean(axis=(1, 3)).ravel()


def contrast(tiles: np.ndarray, epsilon: float) -> float:
    middle = np.median(tiles)
    return float((np.percentile(tiles, 90) - middle) / (np.median(np.abs(tiles - middle)) + epsilon))


def ratio(tiles: np.ndarray, epsilon: float) -> float:
    return float(np.percentile(tiles, 90) / (np.median(tiles) + epsilon))


#: What is made of pairs and of frames for each branch.
_TEMPORAL = {"error": "double", "flow": "double", "local": "double", "tracked": "int", "motion": "double"}
_INTEGRITY = dict.fromkeys(("residual", "divergence", "occlusion", "contrast", "without", "dct"), "double")
_RECOMPRESSION = {"residual": "double", "block": "double", "ratio": "double"}
_FREQUENCY = {"noise": "double", "high": "double", "ratio": "double"}
_FACES = {"candidates": "int", "region": "array<double>"}


def _temporal(pair: Pair, trips: np.ndarray, flow: np.ndarray, warped: np.ndarray) -> tuple:
    residual = np.abs(np.rint(warped) - pair[1].image)
    error, motion = float(residual.mean() / 255), float(np.median(np.hypot(flow[..., 0], flow[..., 1])))
    return error, float(trips.mean()) if len(trips) else None, contrast(tile_means(residual), 1.0), len(trips), motion


def _integrity(pair: Pair, there: np.ndarray, back: np.ndarray, warped: np.ndarray) -> tuple:
    residual = np.abs(warped - pair[1].image)
    tiles = tile_means(residual)
    rest = np.delete(tiles, tiles.argmax())
    return float(np.median(residual) / 255), kernels.divergence(there), kernels.occlusion(there, back), contrast(tiles, 1e-3), contrast(rest, 1e-3), kernels.dct_energy(pair[1].image)


def _first(frame: vision.Look) -> tuple:
    return (None, None, None, None, None, kernels.dct_energy(frame.image))


def _moved(pair: Pair) -> tuple[np.ndarray, np.ndarray]:
    """Flow from one frame to the next, and the first read along it."""
    flow = vision.dense_flow(*pair)
    return flow, vision.warp(pair[0].image, flow)


def _recompression(frame: np.ndarray, quality: int) -> tuple:
    residual = np.abs(frame.astype(np.int16) - vision.jpeg_round_trip(frame, quality))
    return float(residual.mean() / 255), kernels.blockiness(grey(frame)), ratio(tile_means(grey(residual)), 1.0)


def _frequency(frame: np.ndarray, size: tuple[int, int]) -> tuple:
    image = vision.area_resize(grey(frame), *size)
    noise = kernels.high_pass(image, 1.2)
    return float(noise.std() / 255), kernels.radial_ratio(image), ratio(tile_means(np.abs(noise)), 1e-3)


def _content(frame: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    return np.rint(kernels.gray(np.rint(kernels.content(frame, size))))


def _histogram(frame: np.ndarray) -> tuple:
    return (kernels.hue_saturation(np.rint(vision.area_resize(frame, 36, 64)).reshape(-1, 3)).tolist(),)


def _gap():
    return F.greatest(F.lit(1), F.col("frame_index") - F.col("before_index")).cast("int").alias("gap")


def temporal_pairs(frames: DataFrame, cuts: DataFrame | None = None, size: tuple[int, int] = TEMPORAL_SIZE) -> DataFrame:
    """What branches.temporal takes: clip_id, pos, gap, error, flow (mean round-trip error of corners, null without),
    local, tracked, and motion (median flow); pairs at cuts (clip_id, cut) left out."""

    def make(pairs: list[Pair]) -> list[tuple]:
        return [_temporal(p, trips, *_moved(p)) for p, trips in zip(pairs, vision.trips(pairs))]

    pairs = paired(frames, lambda frame: small(frame, size), size, make, _TEMPORAL).where("before_index IS NOT NULL")
    if cuts is not None:
        pairs = S.outside_cuts(pairs, cuts, ["clip_id"], "before_index", "frame_index", "cut")
    return pairs.select("clip_id", "pos", "frame_index", _gap(), *_TEMPORAL)


def recompression_frames(frames: DataFrame, quality: int = QUALITY) -> DataFrame:
    """What branches.recompression takes: clip_id, pos, residual, block, ratio."""
    rows = frames.select("clip_id", "pos", "frame_index", "height", "width", "pixels")
    return features(rows, lambda frame: _recompression(frame, quality), _RECOMPRESSION)


def frequency_frames(frames: DataFrame, size: tuple[int, int] = SPECTRUM_SIZE) -> DataFrame:
    """What branches.frequency takes: clip_id, pos, noise, high, ratio."""
    rows = frames.select("clip_id", "pos", "frame_index", "height", "width", "pixels")
    return features(rows, lambda frame: _frequency(frame, size), _FREQUENCY)


def integrity_pairs(frames: DataFrame, size: tuple[int, int] = CONTENT_SIZE) -> DataFrame:
    """What branches.integrity takes: clip_id, pos, residual, divergence, occlusion, contrast, without, dct; a clip's first
    frame has a dct alone."""

    def pair(p: Pair) -> tuple:
        there, warped = _moved(p)
        return _integrity(p, there, vision.dense_flow(p[1], p[0]), warped)

    rows = paired(frames, lambda frame: _content(frame, size), size, lambda pairs: [pair(p) for p in pairs], _INTEGRITY, _first)
    return rows.where("first OR before_index IS NOT NULL").drop("before_index", "first")


def _scenes(rows: DataFrame) -> DataFrame:
    both = S.pairs(rows, ["clip_id"], "pos", "histogram").where(F.col("previous").isNotNull())
    return both.select("clip_id", "pos", "frame_index", T.histogram_distance(F.col("previous"), F.col("histogram")).alias("distance"))


def scene_pairs(frames: DataFrame) -> DataFrame:
    """What branches.scene takes: clip_id, pos, frame_index, distance of hue and saturation histograms of 36 x 64 from the frame
    before."""
    return _scenes(features(frames.select("clip_id", "pos", "frame_index", "height", "width", "pixels"), _histogram, {"histogram": "array<double>"}))


def evidence(
    frames: DataFrame, size: tuple[int, int] = TEMPORAL_SIZE, content: tuple[int, int] = CONTENT_SIZE, spectrum: tuple[int, int] = SPECTRUM_SIZE,
    quality: int = QUALITY,
) -> dict[str, DataFrame]:
    """The rows of scene_pairs, temporal_pairs, recompression_frames, frequency_frames, detections and integrity_pairs, by the name
    of the branch (face: those of detections), of frames that are read once: each frame is looked at by one task, each pair by
    another. Where a frame shows temporal and integrity the same, they share the flow. Features are kept in the shared folder,
    pixels aren't."""
    kinds = {"recompression": _RECOMPRESSION, "frequency": _FREQUENCY, "face": _FACES, "scene": {"histogram": "array<double>"}, "temporal": _TEMPORAL, "integrity": _INTEGRITY}
    names = {branch: {f"{branch}_{c}": t for c, t in columns.items()} for branch, columns in kinds.items()}
    single = names["recompression"] | names["frequency"] | names["face"] | names["scene"]

    def look(frame: np.ndarray) -> tuple:
        one, two = (x.astype(np.uint8) for x in (small(frame, size), _content(frame, content)))
        rest = (*_recompression(frame, quality), *_frequency(frame, spectrum), *vision.skin_regions(frame), *_histogram(frame))
        return (*rest, one.tobytes(), None if np.array_equal(one, two) else two.tobytes())

    def make(pairs: list[tuple[Pair, ...]]) -> list[tuple]:
        out = []
        for (a, b), trips in zip(pairs, vision.trips([p for p, _ in pairs])):
            there, warped = _moved(a)
            row = _temporal(a, trips, there, warped)
            if any(x is not y for x, y in zip(a, b)):
                there, warped = _moved(b)
            out.append(row + _integrity(b, there, vision.dense_flow(b[1], b[0]), warped))
        return out

    seen = features(frames.select("clip_id", "pos", "frame_index", "height", "width", "pixels"), look, single | {"_look": "binary", "_content": "binary"})
    first = lambda shown: (None,) * len(_TEMPORAL) + _first(shown[1])
    rows = durable(followed(seen, {"_look": size, "_content": content}, make, names["temporal"] | names["integrity"], first))

    def of(branch: str, *more, where: str = "true") -> DataFrame:
        own = (F.col(f"{branch}_{c}").alias(c) for c in kinds[branch])
        return rows.where(where).select("clip_id", "pos", "frame_index", *more, *own)

    return {
        "scene": _scenes(of("scene")),
        "temporal": of("temporal", _gap(), where="before_index IS NOT NULL"),
        "recompression": of("recompression"),
        "frequency": of("frequency"),
        "face": of("face"),
        "integrity": of("integrity", where="first OR before_index IS NOT NULL"),
    }


def detections(frames: DataFrame) -> DataFrame:
    """clip_id, pos, frame_index, candidates (admissible skin-like regions) and region (centre x and y, width, height, as
    shares; null without) of each frame."""
    rows = frames.select("clip_id", "pos", "frame_index", "height", "width", "pixels")
    return features(rows, vision.skin_regions, _FACES)


def face_inputs(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What branches.face takes, from detections(): moves and changes of size from one observation to the next by the frames
    between them, and each one's geometry; and of clips the frames, median candidates and pairs of observations."""
    by = Window.partitionBy("clip_id").orderBy("pos")
    seen = found.where("region IS NOT NULL")
    part = lambda k, c="region": F.get(c, F.lit(k))
    rows = seen.withColumns({"old": F.lag("region").over(by), "steps": F.greatest(F.lit(1), F.col("frame_index") - F.lag("frame_index").over(by))})
    apart = lambda i, j: F.hypot(part(i) - part(i, "old"), part(j) - part(j, "old")) / F.col("steps")
    jumps = rows.select("clip_id", "pos", apart(0, 1).alias("move"), apart(2, 3).alias("resize"), (part(2) / F.greatest(F.lit(0.001), part(3))).alias("geometry"))
    clips = found.groupBy("clip_id").agg(
        F.count("*").alias("frames"), F.percentile("candidates", F.lit(0.5)).alias("candidates"), F.greatest(F.lit(0), F.count("region") - 1).alias("flow_pairs")
    )
    return jumps, clips
