"""Operators on ordered rows of a key: sampling, pairs, runs and events."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import robust as R


def uniform_positions(n: Column, most: int) -> Column:
    """Array of min(most, n) positions from 0 to n - 1, ends among them, evenly spread and cut to integers."""
    m = F.least(F.lit(most), n).cast("int")
    step = (n - 1) / F.nullif(m - 1, F.lit(0))
    spread = F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.when(i == m - 1, n - 1).otherwise(F.floor(i * step)).cast("long"))
    return F.when(n <= 0, F.array().cast("array<bigint>")).when(m == 1, F.array(F.lit(0).cast("long"))).otherwise(spread)


def uniform_sample(df: DataFrame, keys: Sequence[str], order: str, most: int) -> DataFrame:
    """At most `most` rows of each key, by place in `order`, as uniform_positions has them."""
    at = Window.partitionBy(*keys).orderBy(order)
    placed = df.withColumn("_place", (F.row_number().over(at) - 1).cast("long")).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    return placed.where(F.array_contains(uniform_positions(F.col("_n"), most), F.col("_place"))).drop("_place", "_n")


def pairs(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """df with `previous` and `following` values and `gap`, the distance in order to the row before."""
    by = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns({
        "previous": F.lag(value).over(by),
        "following": F.lead(value).over(by),
        "gap": F.greatest(F.lit(1), F.col(order) - F.lag(order).over(by)),
    })


def l1(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays."""
    return R.array_mean(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def strided(df: DataFrame, order: str, n: Column, most: int = 120) -> DataFrame:
    """Every max(1, n div most)-th row."""
    stride = F.greatest(F.lit(1).cast("long"), F.floor(n / most))
    return df.where(F.col(order) % stride == 0)


def adaptive_sample(motion: DataFrame, keys: Sequence[str], order: str, change: str, most: int) -> DataFrame:
    """keys and order of the union of a uniform sample and the third of `most` rows that change most (ties to
    the smaller place), cut to `most` evenly, with both ends kept."""
    strongest = Window.partitionBy(*keys).orderBy(F.col(change).desc_nulls_last(), order)
    moving = motion.withColumn("_k", F.row_number().over(strongest)).where((F.col("_k") <= most // 3) & F.col(change).isNotNull())
    even = uniform_sample(motion.select(*keys, order), keys, order, most)
    both = even.unionByName(moving.select(*keys, order)).distinct()
    ends = motion.groupBy(*keys).agg(F.min(order).alias("_a"), F.max(order).alias("_b"))
    ends = ends.select(*keys, F.explode(F.array_distinct(F.array("_a", "_b"))).alias(order))
    return uniform_sample(both, keys, order, most).unionByName(ends).distinct()


def outside_cuts(pairs_: DataFrame, cuts: DataFrame, keys: Sequence[str], begin: str, end: str, cut: str) -> DataFrame:
    """Pairs neither of whose ends lies within one of a cut. An equi-join on the three places around a cut,
    so that no range join is needed."""
    near = cuts.select(*keys, F.explode(F.array(F.col(cut) - 1, F.col(cut), F.col(cut) + 1)).alias("_at")).distinct()
    for side in (begin, end):
        pairs_ = pairs_.join(near.withColumnRenamed("_at", side), [*keys, side], "left_anti")
    return pairs_


#: Lags that are looked at, as far as half a key's rows (the first always).
LAGS = range(2, 12)


def lag_matches(df: DataFrame, keys: Sequence[str], order: str, value: str, close: Callable[[Column, Column], Column], n: str) -> DataFrame:
    """keys, lag, match_rate for lags 2 to max(2, min(11, n div 2)): share of rows whose value is `close` (later, earlier) to
    that so many places before, among rows that have one. `order` counts places, n the key's rows. All lags come from one
    window: a value meets those before it where it is, and only one flag a lag goes on."""
    by = Window.partitionBy(*keys).orderBy(order)
    most = F.greatest(F.lit(2), F.least(F.lit(LAGS[-1]), F.floor(F.col(n) / 2).cast("int")))
    held = df.select(*keys, value, most.alias("_most"), *(F.lag(F.struct(F.col(value).alias("v")), k).over(by).alias(f"_{k}") for k in LAGS))
    flags = [F.when(F.col(f"_{k}").isNotNull() & (F.lit(k) <= F.col("_most")), F.when(close(F.col(value), F.col(f"_{k}.v")), 1.0).otherwise(0.0)).alias(f"_{k}") for k in LAGS]
    rates = held.select(*keys, *flags).groupBy(*keys).agg(*(F.avg(f"_{k}").alias(f"_{k}") for k in LAGS))
    rows = F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"_{k}").alias("match_rate")) for k in LAGS))
    return rates.select(*keys, F.inline(rows)).where("match_rate IS NOT NULL")
