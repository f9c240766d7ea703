"""The clip source: only asked frames are read, filters are pushed down; the writer and the memo."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.sources import clips


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    clips.register(spark)
    path = str(tmp_path_factory.mktemp("clips"))
    rng = np.random.default_rng(1)
    rows = [(f"c{c}", k, 20, 30, bytearray(np.full((20, 30, 3), (20 * c + k, 100, 200 - k), np.uint8).tobytes())) for c in range(5) for k in range(40)]
    rows = [rows[i] for i in rng.permutation(len(rows))] + [("c0", 99, 20, 30, None), (None, 0, 20, 30, rows[0][4])]
    df = spark.createDataFrame(rows, "clip_id string, frame_index int, height int, width int, pixels binary")
    done = clips.write(df, path, "10:1").collect()
    assert sorted((r.clip_id, r.frames) for r in done) == [(f"c{c}", 40) for c in range(5)]
    return path


def read(spark, folder, **options):
    return spark.read.format("y4m").options(**options).load(folder)


def test_frames_come_back_in_order(spark, folder):
    rows = read(spark, folder).where(F.col("path").endswith("c3.y4m")).orderBy("frame_index").collect()
    assert [r.frame_index for r in rows] == list(range(40)) and rows[7].seconds == 0.7
    colours = np.array([np.frombuffer(bytes(r.pixels), np.uint8).reshape(20, 30, 3)[4, 5] for r in rows]).astype(int)
    assert np.abs(colours - [(60 + k, 100, 200 - k) for k in range(40)]).max() <= 3


def test_pushed_down(spark, folder):
    some = read(spark, folder).where("frame_index IN (3, 17, 99) AND frame_index > 3")
    assert sorted((r.path[-6:-4], r.frame_index) for r in some.select("path", "frame_index").collect()) == [(f"c{c}", 17) for c in range(5)]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bFilter\b", plan)
    assert read(spark, folder, sample=4).where(F.col("path") == f"{folder}/c1.y4m").select("frame_index").collect() == [(0,), (13,), (26,), (39,)]
    assert read(spark, folder, sample=1).count() == 5 and read(spark, folder, sample=400).count() == 200
    assert read(spark, folder).where("frame_index < 0").count() == 0
    assert read(spark, folder).where("frame_index >= 38 AND height = 20").count() == 10


def test_only_asked_frames_are_read(folder, monkeypatch):
    """Bytes that come from the file, counted."""
    taken, opened = [], []

    class Counting:
        def __init__(self, file):
            self.file = file

        def read(self, n):
            out = self.file.read(n)
            taken.append(len(out))
            return out

        def seek(self, at):
            self.file.seek(at)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

    class Store:
        def __init__(self, store):
            self.store = store

        def open_input_file(self, path):
            opened.append(path)
            return Counting(self.store.open_input_file(path))

    real = clips.opened
    reader = clips.Reader({"path": folder})
    assert list(reader.pushFilters([clips.In(("frame_index",), (2, 30)), clips.EqualTo(("path",), f"{folder}/c2.y4m")])) == []
    (group,) = reader.partitions()
    monkeypatch.setattr(clips, "opened", lambda p: (Store(real(p)[0]), real(p)[1]))
    rows = sum(b.num_rows for b in reader.read(group))
    assert rows == 2 and [p[-6:] for p in opened] == ["c2.y4m"]
    assert sum(taken) == 256 + 2 * (6 + 20 * 30 * 3)


def test_what_is_no_clip(spark, tmp_path):
    clips.register(spark)
    with pytest.raises(Exception, match="nowhere"):
        read(spark, f"{tmp_path}/nowhere").count()
    assert read(spark, str(tmp_path)).count() == 0
    (tmp_path / "x.y4m").write_bytes(b"no clip at all")
    with pytest.raises(Exception, match="no Y4M clip"):
        read(spark, str(tmp_path)).count()
    (tmp_path / "x.y4m").write_bytes(b"YUV4MPEG2 W5 H3 F0:0 C420jpeg\n" + 2 * (b"FRAME\n" + bytes([128] * (15 + 12))) + b"FRAME\ncut")
    rows = read(spark, str(tmp_path)).collect()
    assert [(r.frame_index, r.seconds, r.height, r.width, len(r.pixels)) for r in rows] == [(0, None, 3, 5, 45), (1, None, 3, 5, 45)]


def test_memo(spark, folder, tmp_path):
    memo, made = clips.Memo(spark, f"file://{tmp_path}/memo"), []

    def bright(paths):
        made.append(len(paths))
        rows = spark.read.format("y4m").option("sample", 2).load(folder).where(F.col("path").isin(paths))
        return rows.groupBy("path").agg(F.sum(F.length("pixels")).alias("n"))

    first = memo.rows(folder, "sample 2", bright)
    assert first.count() == 5 and made == [5]
    assert sorted(memo.rows(folder, "sample 2", bright).collect()) == sorted(first.collect()) and made == [5]
    memo.rows(folder, "sample 3", bright)
    assert made == [5, 5]
    one = f"{folder}/c0.y4m"
    data = open(one, "rb").read()
    open(one, "wb").write(data[: len(data) // 2])
    try:
        assert memo.rows(folder, "sample 2", bright).count() == 5 and made == [5, 5, 1]
        assert memo.evict(folder, "sample 2") > 0
        assert memo.rows(folder, "sample 2", bright).count() == 5 and made == [5, 5, 1]
    finally:
        open(one, "wb").write(data)
