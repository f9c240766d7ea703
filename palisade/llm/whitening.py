"""Embedding whitening by hierarchical SVD merging.

A part of the vectors is known by how many there are, the whole-number sums of its dimensions, and the singular
values and right singular vectors of its centred rows, all of them (as many as there are dimensions). Two parts are
merged by an SVD of their singular vectors, each scaled by its singular value, with one more row: the difference of
their means times sqrt(n m / (n + m)), which is what centring on the common mean adds. No dimension is left out, so a
merge loses nothing but rounding. Tasks merge their batches, then a tree of tasks merges WAYS parts each; what a
task holds and what comes to the driver at last is one such part, dimensions squared, whatever the number of rows.

Each component c of a vector becomes the whole number x = floor(64 c) + 1000000. Means are never subtracted as
rounded sums: n x - S is a whole number, exact, and only then divided by n, so the large offset costs no digits. The
right singular vectors of all rows are the components, numbered from 1 by falling eigenvalue (singular value squared
over n); their signs are such that the largest entry is positive. A second pass adds up the covariance of the
whitened rows themselves (merged with their means, like the parts), whose distance from the identity is reported.

Vectors that are null or hold null or non-finite entries take no part. Repeated rows count each, and rows with a null
vec_id do too. Vectors of different lengths can't have a covariance together: each length is a fit list of its own,
with its n, components and identity_error. Vectors without entries have no components and no rows. A component
whose eigenvalue is zero within rounding (constant dimensions, fewer vectors than dimensions) can't be whitened: its
rows have a null `whitened`, and identity_error is over the others (0 if there are none); with a trace of zero
`explained` is null. Entries whose x would pass 2**53 count as 2**53. A deviation that fits no long is the largest long.
Other columns are not read. No vectors: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import prepare, record
from palisade.llm.topk import rows_of

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Parts that a task of the tree merges, rows of an SVD of a batch, entries of the output that a task makes at a time.
WAYS, ROWS, VALUES = 16, 1024, 1 << 18
FAR, LONG = 2.0**53, (1 << 63) - 1
#: What rounding may leave of a singular value of zero, as a share of the largest, for each dimension.
ROUNDING = 2.0**-42
PART = pa.schema([("d", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("values", pa.binary()), ("vectors", pa.binary())])
PART_SQL = "d int, n long, sums array<string>, values binary, vectors binary"


def whole(v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(v * SCALE) + OFFSET, -FAR, FAR).astype(np.int64)


def spread(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right singular vectors (by rows), as many as there are columns."""
    d = rows.shape[1]
    if len(rows) < d:
        rows = np.vstack([rows, np.zeros((d - len(rows), d))])
    _, values, vectors = np.linalg.svd(rows, full_matrices=False)
    return values, vectors


class Part:
    """n vectors: exact sums of their dimensions, singular values and vectors of the centred rows."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray) -> None:
        self.n, self.sums, self.values, self.vectors = n, sums, values, vectors

    @classmethod
    def of(cls, x: np.ndarray) -> Part:
        sums = [int(a) for a in x.astype(object).sum(axis=0)] if len(x) * FAR > LONG and np.abs(x).max() > LONG // len(x) else x.sum(axis=0).tolist()
        return cls(len(x), sums, *spread(centred(x, len(x), sums)))

    def merge(self, other: Part) -> Part:
        n, m = self.n, other.n
        apart = np.array([(a * m - b * n) / (n * m) for a, b in zip(self.sums, other.sums)])
        rows = [self.values[:, None] * self.vectors, other.values[:, None] * other.vectors, apart[None] * np.sqrt(n * m / (n + m))]
        return Part(n + m, [a + b for a, b in zip(self.sums, other.sums)], *spread(np.vstack(rows)))

    def row(self) -> pa.RecordBatch:
        return record(PART, [len(self.sums)], [self.n], [list(map(str, self.sums))], [self.values.tobytes()], [self.vectors.tobytes()])


def distances(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray | None:
    """n x - S, if longs hold it."""
    most = max(int(np.abs(x).max(initial=0)) * n, *map(abs, sums), 0)
    return x * n - np.array(sums, dtype=np.int64) if most <= LONG // 2 else None


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, in doubles of differences that are exact."""
    apart = distances(x, n, sums)
    if apart is not None:
        return apart / n
    return np.array([[(a * n - s) / n for a, s in zip(row, sums)] for row in x.tolist()]).reshape(x.shape)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Sum over dimensions of (n x - S) squared, exact."""
    apart = distances(x, n, sums)
    if apart is not None and float(np.abs(apart).max(initial=0)) ** 2 * x.shape[1] < LONG // 2:
        return (apart * apart).sum(axis=1)
    return np.array([min(sum((a * n - s) ** 2 for a, s in zip(row, sums)), LONG) for row in x.tolist()], dtype=np.int64)


def parts(batch: pa.RecordBatch) -> Iterator[tuple[int, Part]]:
    columns = (batch.column(c).to_pylist() for c in PART.names)
    for d, n, sums, values, vectors in zip(*columns):
        yield d, Part(n, list(map(int, sums)), np.frombuffer(values), np.frombuffer(vectors).reshape(d, d))


def merged(found: Iterator[tuple[int, Part]]) -> Iterator[pa.RecordBatch]:
    """One part of each number of dimensions."""
    held: dict[int, Part] = {}
    for d, part in found:
        held[d] = held[d].merge(part) if d in held else part
    for part in held.values():
        yield part.row()


def vectors_of(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array of doubles) of the vectors that take part."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    kept = vectors.where(F.col("embedding").isNotNull() & finite)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: c.cast("double")).alias("v"))


class Whitening:
    """n, exact sums and, by row, up to `components` components of one length of vectors."""

    def __init__(self, part: Part, components: int) -> None:
        d = len(part.sums)
        self.n, self.sums = part.n, part.sums
        variance = part.values**2 / part.n
        self.trace = float(variance.sum())
        kept = min(components, d)
        sign = np.where(np.take_along_axis(part.vectors, np.abs(part.vectors).argmax(axis=1)[:, None], axis=1) < 0, -1.0, 1.0)
        self.components, self.variance = (part.vectors * sign)[:kept], variance[:kept]
        # what rounding leaves of a singular value that is zero
        self.flat = part.values[:kept] <= part.values[0] * d * ROUNDING if self.trace else np.ones(kept, dtype=bool)

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; not a number where the eigenvalue is zero."""
        scale = np.where(self.flat, np.nan, np.sqrt(self.variance))
        return centred(x, self.n, self.sums) @ self.components.T / scale

    def explained(self) -> list[float | None]:
        return [float(e) / self.trace if self.trace else None for e in self.variance]


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """The whitening of each length of vectors."""
    prepare(vectors.sparkSession)
    rows = vectors_of(vectors).select("v").where(F.size("v") > 0)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from merged((n, Part.of(whole(x[at : at + ROWS]))) for b in batches for n, _, x in rows_of(b.column("v")) for at in range(0, len(x), ROWS))

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from merged(p for b in batches for p in parts(b))

    found = rows.mapInArrow(begin, PART_SQL).withColumn("at", F.spark_partition_id()).checkpoint()
    width = (found.agg(F.max("at")).first()[0] or 0) + 1
    while width > WAYS:
        width = -(-width // WAYS)
        dealt = found.withColumn("at", F.col("at") % width).repartition(width, "at")
        found = dealt.drop("at").mapInArrow(go_on, PART_SQL).withColumn("at", F.spark_partition_id()).checkpoint()
        width = min(width, (found.agg(F.max("at")).first()[0] or 0) + 1)
    whole_parts: dict[int, Part] = {}
    for batch in found.drop("at").toArrow().to_batches():
        for d, part in parts(batch):
            whole_parts[d] = whole_parts[d].merge(part) if d in whole_parts else part
    return {d: Whitening(part, components) for d, part in whole_parts.items()}


class Spread:
    """Count, mean and centred products of rows; two merge by their means."""

    def __init__(self, rows: np.ndarray) -> None:
        self.n, self.mean = len(rows), rows.mean(axis=0)
        self.products = (rows - self.mean).T @ (rows - self.mean)

    def merge(self, other: Spread) -> Spread:
        n, apart = self.n + other.n, other.mean - self.mean
        self.products += other.products + np.outer(apart, apart) * (self.n * other.n / n)
        self.mean, self.n = self.mean + apart * (other.n / n), n
        return self


def identity_errors(vectors: DataFrame, models: dict[int, Whitening]) -> dict[int, float]:
    """By length of vectors, the largest absolute entry of the covariance of the whitened rows minus the identity."""
    shared = vectors.sparkSession.sparkContext.broadcast(models)
    schema = pa.schema([("d", pa.int32()), ("n", pa.int64()), ("mean", pa.binary()), ("products", pa.binary())])

    def rows(found: dict[int, Spread]) -> Iterator[pa.RecordBatch]:
        for d, p in found.items():
            yield record(schema, [d], [p.n], [p.mean.tobytes()], [p.products.tobytes()])

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Spread] = {}
        for b in batches:
            for d, _, x in rows_of(b.column("v")):
                model = shared.value[d]
                for at in range(0, len(x), ROWS):
                    part = Spread(model.apply(whole(x[at : at + ROWS]))[:, ~model.flat])
                    held[d] = held[d].merge(part) if d in held else part
        yield from rows(held)

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Spread] = {}
        for part in spreads(batches):
            held[part[0]] = held[part[0]].merge(part[1]) if part[0] in held else part[1]
        yield from rows(held)

    def spreads(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Spread]]:
        for b in batches:
            for d, n, mean, products in zip(*(b.column(c).to_pylist() for c in schema.names)):
                part = Spread.__new__(Spread)
                part.n, part.mean = n, np.frombuffer(mean).copy()
                part.products = np.frombuffer(products).reshape(len(part.mean), len(part.mean)).copy()
                yield d, part

    kind = "d int, n long, mean binary, products binary"
    found = vectors_of(vectors).select("v").where(F.size("v") > 0).mapInArrow(begin, kind)
    dealt = found.withColumn("at", F.spark_partition_id() % WAYS).repartition(WAYS, "at").drop("at")
    held: dict[int, Spread] = {}
    for d, part in spreads(dealt.mapInArrow(go_on, kind).toArrow().to_batches()):
        held[d] = held[d].merge(part) if d in held else part
    return {d: float(np.abs(p.products / p.n - np.eye(len(p.mean))).max(initial=0)) for d, p in held.items()}


def whitened(vectors: DataFrame, models: dict[int, Whitening]) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained: a row for each vector and component."""
    shared = vectors.sparkSession.sparkContext.broadcast(models)
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("d", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, rows, v in rows_of(b.column("v")):
                ids, model = b.column("vec_id").take(pa.array(rows)), shared.value[d]
                kept = len(model.components)
                step = max(1, VALUES // kept)
                for at in range(0, len(v), step):
                    x = whole(v[at : at + step])
                    out, each = model.apply(x).ravel(), np.repeat(np.arange(len(x)), kept)
                    yield record(
                        schema,
                        ids.slice(at, step).take(pa.array(each)),
                        np.tile(np.arange(1, kept + 1), len(x)),
                        np.full(len(out), model.n),
                        deviations(x, model.n, model.sums)[each],
                        pa.array(out, mask=np.isnan(out)),
                        model.explained() * len(x),
                        np.full(len(out), d),
                    )

    return vectors_of(vectors).where(F.size("v") > 0).mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, d int")


def report(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error."""
    models = fit(vectors, components)
    out = whitened(vectors, models)
    errors = identity_errors(vectors, models)
    error = F.lit(None).cast("double")
    for d, value in errors.items():
        error = F.when(F.col("d") == d, value).otherwise(error)
    return out.withColumn("identity_error", error).drop("d")
