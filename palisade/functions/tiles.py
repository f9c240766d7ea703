"""Statistics of a frame's tiles, an array of bounded length, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions import robust as R


def contrast(tiles: Column, epsilon: float) -> Column:
    """How far the 90th percentile lies above the median, in units of the spread."""
    return R.let(R.array_median(tiles), lambda c: (R.array_percentile(tiles, 0.9) - c) / (R.array_mad(tiles, c) + epsilon))


def ratio(tiles: Column, epsilon: float) -> Column:
    return R.array_percentile(tiles, 0.9) / (R.array_median(tiles) + epsilon)


def hottest(tiles: Column) -> Column:
    """Index from 0 of the largest tile, the first of equal ones."""
    return F.array_position(tiles, F.array_max(tiles)).cast("int") - 1


def hotspot(tiles: Column, epsilon: float = 1e-5) -> Column:
    """Mean of the top tenth of tiles, each as deviations from the frame's median; 0 at least."""
    top = F.greatest(F.lit(1), F.floor(F.size(tiles) / 10).cast("int"))
    best = lambda s: R.array_mean(F.slice(s, 1, top))
    scaled = lambda c: R.let(
        R.array_mad(tiles, c), lambda m: best(F.sort_array(F.transform(tiles, lambda v: (v - c) / (m + epsilon)), asc=False))
    )
    return F.greatest(F.lit(0.0), R.let(R.array_median(tiles), scaled))


def without_hottest(tiles: Column) -> Column:
    return R.let(hottest(tiles), lambda k: F.filter(tiles, lambda v, i: i != k))


def block_means(pixels: Column, width: int, rows: int, columns: int) -> Column:
    """Means of equal blocks of a row-major frame of `width`; what a whole number of blocks leaves over is dropped."""
    height = F.floor(F.size(pixels) / width).cast("int")
    h, w = F.floor(height / rows).cast("int"), width // columns

    def block(k: Column) -> Column:
        y, x = F.floor(k / columns).cast("int") * h, F.pmod(k, F.lit(columns)) * w
        cells = F.flatten(F.transform(F.sequence(F.lit(0), h - 1), lambda r: F.slice(pixels, (y + r) * width + x + 1, w)))
        return R.array_mean(cells)

    return F.transform(F.sequence(F.lit(0), F.lit(rows * columns - 1)), block)


def proportional_means(pixels: Column, width: int, rows: int, columns: int) -> Column:
    """Means of blocks whose edges go by proportion, so that no row or column is dropped."""
    height = F.floor(F.size(pixels) / width).cast("int")

    def block(k: Column) -> Column:
        i, j = F.floor(k / columns).cast("int"), F.pmod(k, F.lit(columns)).cast("int")
        y, y2 = F.floor(i * height / rows).cast("int"), F.floor((i + 1) * height / rows).cast("int")
        x, x2 = F.floor(j * width / columns).cast("int"), F.floor((j + 1) * width / columns).cast("int")
        cells = F.flatten(F.transform(F.sequence(y, y2 - 1), lambda r: F.slice(pixels, r * width + x + 1, x2 - x)))
        return R.array_mean(cells)

    return F.transform(F.sequence(F.lit(0), F.lit(rows * columns - 1)), block)


def haar(pixels: Column, width: int) -> dict[str, Column]:
    """The four bands (row-major, half the width) of one level of the Haar transform of a frame of even sides."""
    half = width // 2
    places = F.sequence(F.lit(0), (F.size(pixels) / 4 - 1).cast("int"))

    def band(sb: int, sc: int, sd: int) -> Column:
        def value(k: Column) -> Column:
            at = F.floor(k / half).cast("int") * 2 * width + F.pmod(k, F.lit(half)) * 2
            a, b = F.get(pixels, at), F.get(pixels, at + 1)
            c, d = F.get(pixels, at + width), F.get(pixels, at + width + 1)
            return (a + sb * b + sc * c + sd * d) * 0.5

        return F.transform(places, value)

    return {"ll": band(1, 1, 1), "lh": band(1, -1, -1), "hl": band(-1, 1, -1), "hh": band(-1, -1, 1)}


def mean_abs(a: Column) -> Column:
    return R.array_mean(F.transform(a, lambda v: F.abs(v)))


def histogram_distance(a: Column, b: Column) -> Column:
    """Bhattacharyya distance of two histograms that each sum to one."""
    overlap = F.aggregate(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)), F.lit(0.0), lambda s, v: s + v)
    return F.sqrt(F.greatest(F.lit(0.0), 1.0 - overlap))
