"""Uncompressed clips (Y4M) as a Spark data source that reads only the frames that are asked for, their writer, and a store
that remembers what has been made of files.

    clips.register(spark)
    spark.read.format("y4m").load(folder).where("frame_index IN (0, 30, 60)")   # seeks to three frames of each clip
    spark.read.format("y4m").option("sample", 8).load(folder)                  # eight of each, ends kept

Partitions are groups of clips, planned from a listing on the driver (names and sizes only). Filters on frame_index and path
are pushed down: a clip that is filtered out isn't opened, and frames are sought, not scanned. A frame's place is where it
is found in the file. Paths may be URIs of any store that pyarrow.fs opens."""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from palisade.session import PIXEL_ROWS, bounded

SCHEMA = "path string, frame_index int, seconds double, height int, width int, pixels binary"
_ARROW = pa.schema([("path", pa.string()), ("frame_index", pa.int32()), ("seconds", pa.float64()), ("height", pa.int32()), ("width", pa.int32()), ("pixels", pa.binary())])
#: Clips of a partition; bytes of pixels in a batch.
CLIPS, BATCH = 16, 16 << 20
#: Fixed values of the format.
MAGIC, FRAME = b"YUV4MPEG2", b"FRAME"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """Paths and sizes of the clips at a path: a file, or what a folder holds at any depth."""
    store, at = opened(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(at, recursive=True))
    scheme = path[: path.index(at)] if at in path else ""
    return sorted((scheme + f.path, f.size) for f in found if f.is_file and f.path.endswith(".y4m"))


class Clip:
    """An open clip: height, width, rate (frames a second, or None), frames."""

    def __init__(self, file, size: int) -> None:
        self.file = file
        head = file.read(min(size, 256))
        if not head.startswith(MAGIC) or b"\n" not in head:
            raise ValueError("no Y4M clip")
        line = head[: head.index(b"\n")]
        self.begin = len(line) + 1
        field = {w[:1]: w[1:].decode() for w in line.split(b" ")[1:]}
        self.width, self.height = int(field[b"W"]), int(field[b"H"])
        up, down = (int(x) for x in field.get(b"F", "0:0").split(":"))
        self.rate = up / down if up > 0 and down > 0 else None
        self.kind = re.match("420|444|mono", field.get(b"C", "420"))
        if not self.kind:
            raise ValueError(f"colours of kind {field[b'C']} are not read")
        self.kind = self.kind[0]
        half = ((self.width + 1) // 2) * ((self.height + 1) // 2)
        self.bytes = self.width * self.height + {"420": 2 * half, "444": 2 * self.width * self.height, "mono": 0}[self.kind]
        self.frames = (size - self.begin) // (len(FRAME) + 1 + self.bytes)

    def frame(self, index: int) -> np.ndarray:
        """(height, width, 3) bytes of blue, green, red."""
        self.file.seek(self.begin + index * (len(FRAME) + 1 + self.bytes))
        data = self.file.read(len(FRAME) + 1 + self.bytes)
        if not data.startswith(FRAME + b"\n"):
            raise ValueError(f"frame {index} has parameters of its own, which are not read")
        planes = np.frombuffer(data, np.uint8, offset=len(FRAME) + 1)
        h, w = self.height, self.width
        y = planes[: h * w].reshape(h, w)
        if self.kind == "mono":
            return np.repeat(y[..., None], 3, axis=2)
        ch, cw = (h, w) if self.kind == "444" else ((h + 1) // 2, (w + 1) // 2)
        u, v = (planes[h * w + k * ch * cw :][: ch * cw].reshape(ch, cw) for k in (0, 1))
        if self.kind == "420":
            u, v = (np.repeat(np.repeat(p, 2, axis=0), 2, axis=1)[:h, :w] for p in (u, v))
        return to_bgr(y, u, v)


def to_bgr(y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Brightness of 16 to 235 and colour differences about 128 as bytes of blue, green, red."""
    y, u, v = (y.astype(np.float64) - 16) * 255 / 219, (u.astype(np.float64) - 128) * 255 / 224, (v.astype(np.float64) - 128) * 255 / 224
    return np.clip(np.rint(np.stack([y + 1.772 * u, y - 0.344136 * u - 0.714136 * v, y + 1.402 * v], axis=-1)), 0, 255).astype(np.uint8)


def to_planes(frame: np.ndarray) -> bytes:
    """A colour frame as the bytes of its planes, colour in full."""
    b, g, r = (frame[..., k].astype(np.float64) for k in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    planes = (16 + y * 219 / 255, 128 + (b - y) / 1.772 * 224 / 255, 128 + (r - y) / 1.402 * 224 / 255)
    return b"".join(np.clip(np.rint(p), 0, 255).astype(np.uint8).tobytes() for p in planes)


def spread(count: int, most: int) -> list[int]:
    """At most `most` of `count` places, evenly, ends kept."""
    most = min(most, count)
    return [] if count <= 0 else [0] if most == 1 else [count - 1 if k == most - 1 else int(k * ((count - 1) / (most - 1))) for k in range(most)]


class Group(InputPartition):
    def __init__(self, clips: list[tuple[str, int]]) -> None:
        super().__init__(clips)


class Reader(DataSourceReader):
    """least and most: bounds of the frames that are read; only: those among them (None: all); paths: likewise for clips."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options.get("path", "")
        self.each = int(options.get("clipspergroup", CLIPS))
        self.sample = int(options["sample"]) if "sample" in options else None
        if self.sample is not None and self.sample < 1:
            raise ValueError("sample must be 1 or more")
        self.least, self.most = 0, 2**31 - 1
        self.only: frozenset[int] | None = None
        self.paths: frozenset[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = getattr(f, "attribute", ())
            values = frozenset(f.value) if isinstance(f, In) else frozenset((f.value,)) if isinstance(f, EqualTo) else None
            if name == ("frame_index",) and values is not None:
                self.only = values if self.only is None else self.only & values
            elif name == ("path",) and values is not None:
                self.paths = values if self.paths is None else self.paths & values
            elif name == ("frame_index",) and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.least = max(self.least, f.value + isinstance(f, GreaterThan))
            elif name == ("frame_index",) and isinstance(f, LessThan | LessThanOrEqual):
                self.most = min(self.most, f.value - isinstance(f, LessThan))
            elif not (isinstance(f, IsNotNull) and name in (("frame_index",), ("path",))):
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        clips = [c for c in listed(self.path) if self.paths is None or c[0] in self.paths]
        return [Group(clips[k : k + self.each]) for k in range(0, len(clips), self.each)] or [Group([])]

    def wanted(self, count: int) -> list[int]:
        """Places in a clip of so many frames: those of the sample, or all, that the filters let through."""
        some = spread(count, self.sample) if self.sample is not None else self.only if self.only is not None else range(max(self.least, 0), min(self.most + 1, count))
        return sorted(k for k in some if k is not None and max(self.least, 0) <= k <= self.most and k < count and (self.only is None or k in self.only))

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for path, size in partition.value:
            store, at = opened(path)
            with store.open_input_file(at) as file:
                clip = Clip(file, size)
                wanted = self.wanted(clip.frames)
                step = max(1, BATCH // max(clip.height * clip.width * 3, 1))
                for k in range(0, len(wanted), step):
                    some = wanted[k : k + step]
                    pixels = [clip.frame(i).tobytes() for i in some]
                    seconds = [round(i / clip.rate, 6) if clip.rate else None for i in some]
                    columns = [[path] * len(some), some, seconds, [clip.height] * len(some), [clip.width] * len(some), pixels]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


class Y4M(DataSource):
    @classmethod
    def name(cls) -> str:
        return "y4m"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """The source under its name, and filters pushed down to sources written in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Y4M)


def write(frames: DataFrame, folder: str, rate: str = "24:1") -> DataFrame:
    """Writes a clip for each clip_id of frames (clip_id, frame_index, height, width, pixels), in order of frame_index: clip_id,
    path, frames. A task streams frames to a file of a name of its own and moves it to its place when it is whole, so a task that
    runs again does no harm. A clip's frames are all of one size; null frames are left out."""
    out = pa.schema([("clip_id", pa.string()), ("path", pa.string()), ("frames", pa.int32())])
    folder = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        store.create_dir(base, recursive=True)
        name, file, count, size, draft = None, None, 0, None, ""

        def finish() -> Iterator[pa.RecordBatch]:
            if file is not None:
                file.close()
                store.move(draft, posixpath.join(base, f"{name}.y4m"))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([f"{folder}/{name}.y4m"]), pa.array([count], pa.int32())], schema=out)

        for batch in (whole.slice(k, PIXEL_ROWS) for whole in batches for k in range(0, whole.num_rows, PIXEL_ROWS)):
            for clip, h, w, pixels in zip(*(batch.column(c).to_pylist() for c in ("clip_id", "height", "width", "pixels"))):
                if clip != name:
                    yield from finish()
                    name, count, size, draft = clip, 0, (h, w), posixpath.join(base, f".{clip}-{uuid.uuid4().hex}")
                    file = store.open_output_stream(draft)
                    file.write(MAGIC + f" W{w} H{h} F{rate} Ip A1:1 C444\n".encode())
                if (h, w) != size:
                    raise ValueError(f"clip {clip} has frames of several sizes")
                file.write(FRAME + b"\n" + to_planes(np.frombuffer(pixels, np.uint8).reshape(h, w, 3)))
                count += 1
        yield from finish()

    bounded(frames.sparkSession)
    rows = frames.where("pixels IS NOT NULL AND clip_id IS NOT NULL").select(F.col("clip_id").cast("string").alias("clip_id"), "frame_index", "height", "width", "pixels")
    n = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(n, "clip_id").sortWithinPartitions("clip_id", "frame_index")
    return ordered.mapInArrow(run, "clip_id string, path string, frames int")


class Memo:
    """Rows made of files, remembered under a folder: by path, size, time of change and what was asked of the file. A call makes
    rows only for files that aren't there yet; a file that changes is another file. Each call adds a folder of its own, so
    calls at the same time don't disturb each other (a file that both make is taken once)."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _held(self) -> DataFrame | None:
        store, at = opened(self.folder)
        names = [f.path for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if not f.is_file and store.get_file_info(f"{f.path}/_SUCCESS").is_file]
        scheme = self.folder[: self.folder.index(at)]
        return self.spark.read.parquet(*(scheme + n for n in sorted(names))) if names else None

    def rows(self, path: str, asked: str, make: Callable[[list[str]], DataFrame]) -> DataFrame:
        """make(paths)'s rows (with a column path) of all files at a path; made now for those that are new."""
        files = self.spark.createDataFrame([(p, n, t) for p, n, t in changed(path)], "path string, size long, changed long")
        keyed = files.select(F.sha2(F.concat_ws("|", "path", "size", "changed", F.lit(asked)), 256).alias("memo_key"), "path")
        held = self._held()
        new = keyed if held is None else keyed.join(held.select("memo_key").distinct(), "memo_key", "left_anti")
        todo = sorted(r.path for r in new.select("path").collect())
        if todo:
            made = make(todo).join(F.broadcast(new), "path")
            made.write.parquet(f"{self.folder}/{uuid.uuid4().hex}")
            held = self._held()
        return keyed.join(held.drop("path"), "memo_key").drop("memo_key").distinct()

    def evict(self, path: str, *asked: str) -> int:
        """Forgets what no file at the path, with one of these askings, still leads to: the bytes that are freed."""
        live = {self._key(p, n, t, a) for p, n, t in changed(path) for a in asked}
        store, at = opened(self.folder)
        freed = 0
        for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            scheme = self.folder[: self.folder.index(at)]
            keys = {r[0] for r in self.spark.read.parquet(scheme + f.path).select("memo_key").distinct().collect()}
            if not keys & live:
                freed += sum(x.size for x in store.get_file_info(fs.FileSelector(f.path)) if x.is_file)
                store.delete_dir(f.path)
        return freed

    @staticmethod
    def _key(path: str, size: int, time: int, asked: str) -> str:
        import hashlib

        return hashlib.sha256("|".join((path, str(size), str(time), asked)).encode()).hexdigest()


def changed(path: str) -> list[tuple[str, int, int]]:
    """Paths, sizes and times of change (nanoseconds) of the clips at a path."""
    out = []
    for p, n in listed(path):
        store, at = opened(p)
        out.append((p, n, store.get_file_info(at).mtime_ns or 0))
    return out
