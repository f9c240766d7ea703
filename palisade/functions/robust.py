"""Robust statistics. Null, NaN and infinite values are no evidence and drop out before any statistic."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palisade.functions import longkeys

#: Scale of the median absolute deviation, floor of a scale, outlier bound.
MAD_SCALE, FLOOR, OUTLIER = 1.4826, 1e-9, 3.5


def finite(x: Column | str) -> Column:
    """x where it is a number, else null."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x.cast("double"))


def median(x: Column | str) -> Column:
    """The midpoint median; an aggregate that combines before the shuffle."""
    return F.percentile(finite(x), F.lit(0.5))


def percentile(x: Column | str, share: float) -> Column:
    return F.percentile(finite(x), F.lit(min(1.0, max(0.0, share))))


def clipped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x held between low and high; null stays null, NaN and infinity become null."""
    return F.when(finite(x).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def falsy(x: Column, other: float) -> Column:
    """x, or `other` where x is null or zero."""
    return F.coalesce(F.nullif(x, F.lit(0.0)), F.lit(other))


def unit(x: Column) -> Column:
    """x clipped to [0, 1], nothing counting as 0."""
    return or_zero(clipped(x))


def positive(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x)


def outlier_share(x: Column, center: Column, mad: Column, count: Column) -> Column:
    """Aggregate: share of x far from center in units of mad; 0 for fewer than three values; with no spread,
    the share of values off the center."""
    off = F.abs(x - center)
    far = F.when(mad < FLOOR, off > FLOOR).otherwise(off > F.lit(OUTLIER) * F.lit(MAD_SCALE) * mad)
    return F.when(count < 3, F.lit(0.0)).otherwise(F.count_if(far) / F.nullif(F.count(x), F.lit(0)))


def summary(df: DataFrame, keys: Sequence[str], value: str, most: int = longkeys.LONG) -> DataFrame:
    """keys, n, median, mad, outlier_fraction of a value. Two grouped passes that combine before the shuffle,
    and a join of one row a key, rather than a window that holds a key's rows in one task. Keys of more than `most`
    values get their medians from a sort over ranges instead of one buffer."""
    x = finite(value)
    long = longkeys.find(df, keys, x, most)
    one = longkeys.quantiles(df, keys, x, {"median": 0.5}, long)
    with_center = df.select(*keys, x.alias("_v")).join(one, list(keys))
    two = longkeys.quantiles(with_center, keys, F.abs(F.col("_v") - F.col("median")), {"mad": 0.5}, long)
    three = with_center.join(two.select(*keys, "mad"), list(keys))
    return three.groupBy(*keys, "n", "median", "mad").agg(
        outlier_share(F.col("_v"), F.col("median"), F.col("mad"), F.col("n")).alias("outlier_fraction")
    )


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float], most: int = longkeys.LONG) -> DataFrame:
    """keys, n and a column for each named share of a value, for keys of any length."""
    x = finite(value)
    return longkeys.quantiles(df, keys, x, {name: min(1.0, max(0.0, s)) for name, s in shares.items()}, longkeys.find(df, keys, x, most))


def expanding(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, most: int = longkeys.LONG, bits: int | None = None) -> DataFrame:
    """df with `past_n`, `past_median` and `past_mad` of the finite values of a key's earlier rows. A key's rows
    pass through one task in order, which keeps that key's values once, sorted, not a list for each row; keys of more than
    `most` values go in blocks of 2**bits rows through many tasks (longkeys)."""
    held = df.withColumn("_x", finite(value))
    given = list(df.columns)
    schema = StructType(list(df.schema.fields)).add("past_n", "long").add("past_median", "double").add("past_mad", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return longkeys.answered(batches, keys, given)

    def whole(rows: DataFrame) -> DataFrame:
        return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)

    long = longkeys.find(df, keys, finite(value), most)
    if long is None:
        return whole(held)
    both = longkeys.marked(held, keys, long)
    longest = long.agg(F.max("values")).first()[0]
    blocks = longkeys.expanding(both.where("_k IS NOT NULL"), order, longest, given, schema, bits)
    return whole(both.where("_k IS NULL").drop("_k")).unionByName(blocks)


def robust_z(x: Column, center: Column, mad: Column) -> Column:
    return (x - center) / (F.lit(MAD_SCALE) * mad + F.lit(FLOOR))


# the same over arrays, for groups whose size is bounded by their kind (evidence groups, tiles, samples of a clip)


def let(value: Column, body) -> Column:
    """body of value, with value computed once; lambdas would compute it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sorted_median(s: Column) -> Column:
    n = F.size(s)
    return F.when(n > 0, (F.try_element_at(s, ((n + 1) / 2).cast("int")) + F.try_element_at(s, (n / 2).cast("int") + 1)) / 2.0)


def array_median(a: Column) -> Column:
    return let(F.array_sort(a), _sorted_median)


def array_mad(a: Column, center: Column | None = None) -> Column:
    return let(array_median(a) if center is None else center, lambda c: array_median(F.transform(a, lambda v: F.abs(v - c))))


def array_percentile(a: Column, share: float) -> Column:
    q = F.lit(float(share)) * (F.size(a) - 1)

    def at(s: Column) -> Column:
        low = F.try_element_at(s, F.floor(q).cast("int") + 1)
        high = F.try_element_at(s, F.least(F.size(a), F.floor(q).cast("int") + 2))
        return F.when(F.size(a) > 0, low + (high - low) * (q - F.floor(q)))

    return let(F.array_sort(a), at)


def array_mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a))


def array_outlier_fraction(a: Column) -> Column:
    n = F.size(a)

    def share(off: Column) -> Column:
        far = lambda m: F.size(F.filter(off, lambda v: F.when(m < FLOOR, v > FLOOR).otherwise(v / (F.lit(MAD_SCALE) * m) > OUTLIER)))
        return let(array_median(off), far) / n

    off = let(array_median(a), lambda c: F.transform(a, lambda v: F.abs(v - c)))
    return F.when(n < 3, F.lit(0.0)).otherwise(let(off, share))


def longest_run(df: DataFrame, keys: Sequence[str], order: str, flag: str) -> DataFrame:
    """keys, longest_run: most rows in a row, by `order`, for which flag holds."""
    by = Window.partitionBy(*keys).orderBy(order)
    same = Window.partitionBy(*keys, flag).orderBy(order)
    island = F.row_number().over(by) - F.row_number().over(same)
    runs = df.select(*keys, flag, island.alias("_island")).groupBy(*keys, flag, "_island").count()
    return runs.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col(flag), F.col("count"))), F.lit(0)).cast("long").alias("longest_run"))
