"""Order statistics of keys with more values than one task should hold, exact.

Quantiles: a key's different values, counted before the shuffle, are sorted over ranges; the counts of the ranges before give
each value its rank, and the rows at the wanted ranks are picked.

Statistics of all earlier values: a key's rows are cut into blocks by time and its values into chunks by size. Counts by
(block, chunk) say, before any row is looked at, in which chunks the medians of a block's rows and the ends of their median
absolute deviations can lie; a block gets just those chunks' earlier values and the numbers of values between them. So a task
holds one block and about as many earlier values, whatever the key's length.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.session import durable

#: Values of a key beyond which it is long: a few dozen megabytes in an aggregate's buffer.
LONG = 1_000_000
#: Requests for one chunk that one copy of it answers.
SHARED = 64


def find(df: DataFrame, keys: Sequence[str], value: Column, most: int = LONG) -> DataFrame | None:
    """keys, values (how many) and _k (a number) of keys with more than `most` values; None if there are none. Null is a key."""
    found = df.where(value.isNotNull()).groupBy(*keys).agg(F.count("*").alias("values")).where(F.col("values") > most)
    if found.isEmpty():
        return None
    return durable(found.withColumn("_k", F.monotonically_increasing_id()))


def marked(df: DataFrame, keys: Sequence[str], long: DataFrame) -> DataFrame:
    """df with _k, null for keys that aren't long."""
    dim = long.select("_k", *(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)))
    same = reduce(lambda a, b: a & b, (df[k].eqNullSafe(dim[f"_key{i}"]) for i, k in enumerate(keys)))
    return df.join(dim, same, "left").select(*df.columns, "_k")


def quantiles(df: DataFrame, keys: Sequence[str], value: Column, shares: Mapping[str, float], long: DataFrame | None) -> DataFrame:
    """keys, n and a column for each named share: linear between the two nearest of a key's values, as percentile() has it."""
    plain = [F.count("_x").alias("n"), *(F.percentile("_x", F.lit(s)).alias(name) for name, s in shares.items())]
    rows = df.select(*keys, value.alias("_x"))
    if long is None:
        return rows.groupBy(*keys).agg(*plain)
    both = marked(rows, keys, long)
    short = both.where("_k IS NULL").groupBy(*keys).agg(*plain)
    counts = both.where("_k IS NOT NULL AND _x IS NOT NULL").groupBy("_k", "_x").agg(F.count("*").alias("_n"))
    # an id holds the number of the range above its lowest 33 bits
    counts = counts.repartitionByRange("_k", "_x").sortWithinPartitions("_k", "_x").withColumn("_id", F.monotonically_increasing_id())
    counts = durable(counts.withColumn("_part", F.shiftright("_id", 33)))
    parts = counts.groupBy("_k", "_part").agg(F.sum("_n").alias("_all"))
    ahead = Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_start", F.coalesce(F.sum("_all").over(ahead), F.lit(0)))
    above = Window.partitionBy("_k", "_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("_before", F.coalesce(F.sum("_n").over(above), F.lit(0))).join(parts.drop("_all"), ["_k", "_part"])
    ranked = ranked.withColumn("_before", F.col("_before") + F.col("_start")).join(long, "_k")

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n")), F.col("_x")))

    n, out = F.col("values"), []
    for name, s in shares.items():
        place = F.lit(float(s)) * (n - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        part = F.max(place) - F.floor(F.max(place))
        out.append(F.when(low == high, low).otherwise((1.0 - part) * low + part * high).alias(name))
    picked = ranked.groupBy(*keys).agg(F.max(n).alias("n"), *out)
    return short.unionByName(picked)


def near_center(s, center: float, k: int) -> float:
    """The k-th smallest (from 0) distance to center in a sorted list, by halving what can come from its left side."""
    at = s.below(center) if isinstance(s, Zones) else bisect_left(s, center)
    low, high = max(0, k + 1 - (len(s) - at)), min(at, k + 1)
    while low < high:  # the least number from the left whose next distance there is not among the k + 1 smallest
        left = (low + high) // 2
        if center - s[at - left - 1] < s[at + k - left] - center:
            low = left + 1
        else:
            high = left
    right = k + 1 - low
    return max(center - s[at - low] if low else 0.0, s[at + right - 1] - center if right else 0.0)


def statistics(past) -> tuple[int, float | None, float | None]:
    """How many, their median and their median absolute deviation, of a sorted list or zones."""
    n = len(past)
    if not n:
        return 0, None, None
    center = (past[(n - 1) // 2] + past[n // 2]) / 2.0
    below = near_center(past, center, (n - 1) // 2)
    return n, center, (below + (below if n % 2 else near_center(past, center, n // 2))) / 2.0


class Zones:
    """A sorted list known in three zones, around the median and where the deviation can end on each side; of the values in
    the four gaps around them only the number is known.

    An index into a gap gives a value that sorts there and says enough: values of inner gaps are nearer to the median than
    the deviation, as is the middle zone's end that stands for them; outer ones are farther, as infinity is."""

    def __init__(self, bounds: Sequence[float], gaps: Sequence[int], zones: Sequence[Sequence[float]]) -> None:
        """bounds: the largest value of each gap and zone but the last gap, in order."""
        self.bounds, self.gaps, self.zones = list(bounds), list(gaps), [list(z) for z in zones]

    def __len__(self) -> int:
        return sum(self.gaps) + sum(map(len, self.zones))

    def __getitem__(self, rank: int) -> float:
        middle = self.zones[1]
        for gap, zone, stand_in in zip(self.gaps, self.zones, (-math.inf, middle[0] if middle else None, middle[-1] if middle else None)):
            if rank < gap:
                return stand_in
            rank -= gap
            if rank < len(zone):
                return zone[rank]
            rank -= len(zone)
        return math.inf

    def below(self, center: float) -> int:
        """How many values are under center, which lies in the middle zone."""
        return self.gaps[0] + len(self.zones[0]) + self.gaps[1] + bisect_left(self.zones[1], center)

    def insert(self, x: float) -> None:
        place = bisect_left(self.bounds, x)
        if place % 2:
            insort(self.zones[place // 2], x)
        else:
            self.gaps[place // 2] += 1


def zones_of(low: np.ndarray, high: np.ndarray, held: np.ndarray, own: int) -> tuple[list[float], list[int], np.ndarray]:
    """Bounds, gaps and each chunk's zone (0 to 2, or -1) for a block with `own` values, before which chunks from low to high
    (ascending) have `held` values. Bounds are proven for every row of the block: its own values shift a rank by `own` at most,
    and chunks count with their nearest and farthest values."""
    n, inf = int(held.sum()), math.inf
    if n <= 4 * own + 8:
        return [-inf, -inf, -inf, inf, inf, inf], [0, 0, 0, 0], np.ones(len(low), np.int64)
    upto = np.cumsum(held)
    first = int(np.searchsorted(upto, (n - 1) // 2 - own - 1, side="right"))
    last = int(np.searchsorted(upto, (n + own) // 2 + 1, side="right"))
    least, greatest = low[first], high[last]  # all medians are between
    near, far = np.maximum(0.0, np.maximum(low - greatest, least - high)), np.maximum(high - least, greatest - low)
    order = np.argsort(near, kind="stable")
    inner = near[order][np.argmax(np.cumsum(held[order]) + own > (n - 1) // 2)]
    order = np.argsort(far, kind="stable")
    outer = far[order][np.argmax(np.cumsum(held[order]) >= (n + own) // 2 + 1)]
    k = np.arange(len(low))
    left, right = k < first, k > last
    place = np.full(len(low), 3)
    place[left] = np.where(least - high > outer, 0, np.where(greatest - low >= inner, 1, 2))[left]
    place[right] = np.where(low - greatest > outer, 6, np.where(high - least >= inner, 5, 4))[right]
    bounds, top = [], -inf
    for p in range(6):
        if (here := place == p).any():
            top = float(high[here].max())
        bounds.append(top)
    return bounds, [int(held[place == p].sum()) for p in (0, 2, 4, 6)], np.where(place % 2 == 1, place // 2, -1)


_PLAN = "_k long, _b long, bounds array<double>, gaps array<long>, chunks array<long>, zones array<long>"


def _planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A plan for each block, from rows (_k, _b, _c, n, lo, hi) in order: a key's chunks (_b -1), then, block after block, the
    number of its values (_c -1) and its chunks' counts."""
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.float64()), *(pa.list_(pa.int64()),) * 3)
    names = ["_k", "_b", "bounds", "gaps", "chunks", "zones"]
    key, low, high, index, held = None, [], [], {}, None
    for batch in batches:
        out = []
        for k, b, c, n, lo, hi in zip(*(batch.column(x).to_pylist() for x in ("_k", "_b", "_c", "n", "lo", "hi"))):
            if k != key:
                key, low, high, index, held = k, [], [], {}, None
            if b == -1:
                index[c] = len(low)
                low.append(lo)
                high.append(hi)
                continue
            if held is None:
                low, high, held, numbers = np.array(low), np.array(high), np.zeros(len(low), np.int64), np.array(list(index))
            if c == -1:
                bounds, gaps, zone = zones_of(low, high, held, n)
                asked = (zone >= 0) & (held > 0)
                out.append((k, b, bounds, gaps, numbers[asked].tolist(), zone[asked].tolist()))
            else:
                held[index[c]] += n
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=names)


def answered(batches: Iterator[pa.RecordBatch], keys: Sequence[str], given: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The columns `given` and past_n, past_median, past_mad of rows in order; _x is a row's value. The first row of a block has
    its zones in _zones, if rows are in blocks, and isn't one of the rows itself."""
    last, past = None, []
    for batch in batches:
        out, kept = [], []
        zones = batch.column("_zones").to_pylist() if "_zones" in batch.schema.names else [None] * batch.num_rows
        for i, (z, x, *key) in enumerate(zip(zones, *(batch.column(c).to_pylist() for c in ("_x", *keys)))):
            if z is not None:
                past = Zones(z["bounds"], z["gaps"], (z["left"], z["middle"], z["right"]))
                last = key
                continue
            if key != last:
                last, past = key, []
            kept.append(i)
            out.append(statistics(past))
            if x is not None:
                past.insert(x) if isinstance(past, Zones) else insort(past, x)
        own = [batch.column(c).take(pa.array(kept, pa.int64())) if len(kept) < batch.num_rows else batch.column(c) for c in given]
        more = [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.float64(), pa.float64()))]
        yield pa.RecordBatch.from_arrays([*own, *more], names=[*given, "past_n", "past_median", "past_mad"])


def expanding(rows: DataFrame, order: Sequence[str], longest: int, given: Sequence[str], schema, bits: int | None = None) -> DataFrame:
    """The columns `given` and the statistics of earlier values (schema) of rows of long keys (_k, _x, order); 2**bits rows are
    a block."""
    bits = bits or max(12, round(math.log2(8 * math.sqrt(longest))))
    rows = rows.repartitionByRange("_k", *order).sortWithinPartitions("_k", *order).withColumn("_id", F.monotonically_increasing_id())
    rows = durable(rows.withColumn("_b", F.shiftright("_id", bits)))
    values = rows.where("_x IS NOT NULL").select("_k", "_x", "_b").repartitionByRange("_k", "_x", "_b").sortWithinPartitions("_k", "_x", "_b")
    values = durable(values.withColumn("_c", F.shiftright(F.monotonically_increasing_id(), bits)))
    ends = [F.count("*").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi")]
    cells = values.groupBy("_k", "_b", "_c").agg(*ends)
    chunks = values.groupBy("_k", "_c").agg(*ends).withColumn("_b", F.lit(-1).cast("long"))
    blocks = rows.groupBy("_k", "_b").agg(F.count("_x").alias("n")).withColumn("_c", F.lit(-1).cast("long"))
    counts = cells.unionByName(chunks).unionByName(blocks, allowMissingColumns=True).select("_k", "_b", "_c", "n", "lo", "hi")
    # one task a key, on counts alone: with blocks of 8 roots of n they are a 64th of its values at most
    plan = durable(counts.repartition("_k").sortWithinPartitions("_k", "_b", "_c").mapInArrow(_planned, _PLAN))
    asked = plan.select("_k", "_b", F.explode(F.arrays_zip("chunks", "zones")).alias("e")).select("_k", "_b", F.col("e.chunks").alias("_c"), F.col("e.zones").alias("_z"))
    # chunks around a steady median are asked for by every block: copies of them share the work
    copies = asked.groupBy("_k", "_c").agg(F.ceil(F.count("*") / SHARED).cast("int").alias("_copies"))
    packed = values.groupBy("_k", "_c").agg(F.sort_array(F.collect_list(F.struct("_x", "_b"))).alias("_values"))
    packed = packed.join(copies, ["_k", "_c"]).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies")
    asked = asked.join(copies, ["_k", "_c"]).withColumn("_copy", F.pmod(F.hash("_b"), "_copies")).drop("_copies")
    earlier = F.expr("transform(filter(_values, v -> v._b < _b), v -> v._x)")
    got = asked.join(packed, ["_k", "_c", "_copy"]).select("_k", "_b", F.struct("_z", "_c", earlier.alias("xs")).alias("e"))
    got = got.groupBy("_k", "_b").agg(F.sort_array(F.collect_list("e")).alias("e"))
    none = F.array().cast("array<double>")

    def zone(k: int, name: str) -> Column:
        return F.coalesce(F.flatten(F.transform(F.filter("e", lambda e: e["_z"] == k), lambda e: e["xs"])), none).alias(name)

    heads = plan.join(got, ["_k", "_b"], "left").select(
        "_k", "_b", F.lit(-1).cast("long").alias("_id"), F.struct("bounds", "gaps", zone(0, "left"), zone(1, "middle"), zone(2, "right")).alias("_zones")
    )
    both = rows.unionByName(heads, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return answered(batches, ("_k", "_b"), given)

    # a given number, as adaptive execution would merge blocks by their bytes, which are few next to the work on them
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(tasks, "_k", "_b").sortWithinPartitions("_k", "_b", "_id").mapInArrow(run, schema)
