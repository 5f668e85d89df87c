"""Pixel and slice statistics. Long-form stacks have a key column (date, or ref and rep), y, x and values; missing is NULL."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fringework import shared
from fringework.functions.columns import wrap
from fringework.operators.inversion import dense


def scatterer_stats(stack: DataFrame, value: str = "intensity", mask: DataFrame | None = None) -> DataFrame:
    """Mean and population deviation over dates of each pixel, after scaling each date to the mean over all dates' means.

    ``stack``: date, y, x, intensity. ``mask``: y, x to keep. The dates' means are a small table that Spark may broadcast.
    """
    if mask is not None:
        stack = stack.join(mask.select("y", "x").distinct(), ["y", "x"], "left_semi")
    by_date = stack.groupBy("date").agg(F.avg(value).alias("stack_average"))
    whole = by_date.agg(F.avg("stack_average").alias("m"))
    norm = by_date.join(F.broadcast(whole), F.lit(True)).select("date", F.try_divide("m", "stack_average").alias("norm"))
    scaled = stack.join(norm, "date").select("y", "x", (F.col("norm") * F.col(value)).alias("v"))
    return scaled.groupBy("y", "x").agg(F.avg("v").alias("average"), F.stddev_pop("v").alias("deviation"))


def date_means(stack: DataFrame, value: str = "intensity", func: Callable[[Column], Column] = F.avg) -> DataFrame:
    """One number for each date by ``func``, an aggregate of a column."""
    return stack.groupBy("date").agg(func(F.col(value)).alias("stack_average"))


def scatterer_function(stats: DataFrame) -> DataFrame:
    """average / (2 deviation), NULL where that isn't finite."""
    return stats.withColumn("psf", F.try_divide("average", F.col("deviation") * 2))


def histogram(data: DataFrame, value: str, bins: int, low: float, high: float) -> DataFrame:
    """``bin, n`` for all of ``bins`` equal bins from ``low`` to ``high``; the last is closed on the right, values outside are left out."""
    width = (high - low) / bins
    k = F.when(F.col(value) == high, bins - 1).otherwise(F.floor((F.col(value) - low) / width).cast("int"))
    counts = data.filter((F.col(value) >= low) & (F.col(value) <= high)).groupBy(k.alias("bin")).agg(F.count("*").alias("n"))
    every = data.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def cumulative_histogram(data: DataFrame, value: str, bins: int, low: float, high: float) -> DataFrame:
    h = histogram(data, value, bins, low, high)
    return h.withColumn("total", F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))  # ``bins`` rows


def middle(data: DataFrame, value: str) -> DataFrame:
    mean = data.agg(F.avg(value).alias("mean"))
    return mean.join(F.broadcast(quantiles(data, value, [0.5]).withColumnRenamed("q0", "median")), F.lit(True))


def correlations(stack: DataFrame, key: str, value: str, mask_diagonal: bool = False) -> DataFrame:
    """Pearson correlation of each two slices over the pixels that all slices have, rounded to 2.

    A pixel's slices are one row, one shuffle; tasks add up the products of all slice pairs as matrices around the slices'
    means, so that what leaves them are as many numbers as there are slice pairs, which are few.
    """
    shared.ship(stack.sparkSession)
    rows = stack.filter(F.col(value).isNotNull())
    means = {r[0]: r[1] for r in rows.groupBy(key).agg(F.avg(value)).collect()}  # one number for each slice
    keys = sorted(means)
    number = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(i)) for i, k in enumerate(keys))) if keys else F.create_map()
    pixels = rows.select("y", "x", F.struct(number[F.col(key)].alias("k"), F.col(value).cast("double").alias("v")).alias("s")).groupBy("y", "x").agg(F.collect_list("s").alias("s")).filter(F.size("s") == len(keys)) if keys else rows.select("y", "x", F.array().alias("s")).limit(0)
    kind, n = stack.schema[key].dataType.simpleString(), len(keys)
    middle_ = np.array([means[k] for k in keys], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, one, two = 0, np.zeros(n), np.zeros((n, n))
        for b in batches:
            v = dense(b.column(0), n, "v")[0] - middle_
            many, one, two = many + len(v), one + v.sum(0), two + v.T @ v
        i, j = (x.reshape(-1) for x in np.indices((n, n)))
        yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in i], kinds), pa.array([keys[k] for k in j], kinds), pa.array(np.full(n * n, many), pa.int64()), pa.array(one[i]), pa.array(one[j]), pa.array(np.diag(two)[i]), pa.array(np.diag(two)[j]), pa.array(two[i, j])], names=["k1", "k2", "n", "a", "b", "aa", "bb", "ab"])

    kinds = to_arrow_type(stack.schema[key].dataType)
    sums = pixels.select("s").mapInArrow(run, f"k1 {kind}, k2 {kind}, n long, a double, b double, aa double, bb double, ab double")
    sums = sums.groupBy("k1", "k2").agg(*(F.sum(c).alias(c) for c in ("n", "a", "b", "aa", "bb", "ab"))).filter("n > 0")
    left, right = F.col("aa") - F.col("a") * F.col("a") / F.col("n"), F.col("bb") - F.col("b") * F.col("b") / F.col("n")
    out = sums.select("k1", "k2", F.round(F.try_divide(F.col("ab") - F.col("a") * F.col("b") / F.col("n"), F.sqrt(left * right)), 2).alias("corr"))
    return out.withColumn("corr", F.when(F.col("k1") != F.col("k2"), F.col("corr"))) if mask_diagonal else out


def residual_rmse(data: DataFrame, solution: DataFrame, value: str = "phase", weight: str | None = None) -> DataFrame:
    """Per pixel the root of the mean squared wrapped residual of pairs against a displacement history.

    ``data``: ref, rep, y, x, value[, weight]; ``solution``: date, y, x, displacement. The divisor is the number of all
    pairs whose dates are known, whether a pixel has a value there or not.
    """
    dates = solution.select("date").distinct()
    used = data.join(dates, data["ref"] == dates["date"], "left_semi").join(dates, data["rep"] == dates["date"], "left_semi")
    n = F.broadcast(used.select("ref", "rep").distinct().agg(F.count("*").alias("n_pairs")))
    s1 = solution.select(F.col("date").alias("ref"), "y", "x", F.col("displacement").alias("d1"))
    s2 = solution.select(F.col("date").alias("rep"), "y", "x", F.col("displacement").alias("d2"))
    e = wrap(F.col(value) - (F.col("d2") - F.col("d1")))
    rows = used.join(s1, ["ref", "y", "x"]).join(s2, ["rep", "y", "x"])
    if weight is None:
        total = F.sum(e * e)
    else:
        w = F.when(e.isNotNull(), F.col(weight))
        total = F.try_divide(F.sum(w * e * e), F.sum(F.col(weight)))
    return rows.groupBy("y", "x").agg(total.alias("total")).join(n, F.lit(True)).select("y", "x", F.sqrt(F.col("total") / F.col("n_pairs")).alias("rmse"))


def by_axis(grid: DataFrame, axis: str, value: str) -> DataFrame:
    return grid.groupBy(axis).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def bounds(grid: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return grid.agg(F.min(x).alias("minx"), F.min(y).alias("miny"), F.max(x).alias("maxx"), F.max(y).alias("maxy"))


#: Rows of a bracket around a quantile that one task may sort.
MOST_BRACKET = 1_000_000


def quantiles(data: DataFrame, value: str, at: list[float], by: list[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, as for plot limits.

    With ``by`` each group's values make up its task's buffer. Without, no task holds the whole column: brackets around the
    quantiles are narrowed by histograms, each one pass, until few values are left in them; only these are sorted.
    """
    if by:
        return data.groupBy(*by).agg(*(F.percentile(value, F.lit(q)).alias(f"q{i}") for i, q in enumerate(at)))
    v = data.select(F.col(value).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    total, low, high = v.agg(F.count("*"), F.min("v"), F.max("v")).first()
    spark = data.sparkSession
    if not total:
        return spark.createDataFrame([(None,) * len(at)], ", ".join(f"q{i} double" for i in range(len(at))))
    found: dict[int, float] = {}
    ranks = sorted({r for q in at for r in (math.floor(q * (total - 1)), math.ceil(q * (total - 1)))})
    for rank in ranks:
        if rank not in found:
            found |= _ranked(v, [r for r in ranks if r not in found], rank, low, high, total)
    out = []
    for q in at:
        place = q * (total - 1)
        a, b = found[math.floor(place)], found[math.ceil(place)]
        out.append(a + (b - a) * (place - math.floor(place)))
    return spark.createDataFrame([tuple(out)], ", ".join(f"q{i} double" for i in range(len(at))))


def _ranked(v: DataFrame, wanted: list[int], rank: int, low: float, high: float, inside: int, bins: int = 4096) -> dict[int, float]:
    """The values at ``rank`` (from 0) and at other wanted ranks near it, from ever narrower brackets."""
    below = 0
    while inside > MOST_BRACKET and low < high:
        width = (high - low) / bins
        bin_ = F.least(F.floor((F.col("v") - low) / width).cast("int"), F.lit(bins - 1)) if width > 0 else F.lit(0)
        rows = v.filter(F.col("v").between(low, high)).groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("z")).orderBy("b").collect()
        for r in rows:
            if below + r.n > rank:
                break
            below += r.n
        if (r.a, r.z) == (low, high):
            break
        low, high, inside = r.a, r.z, r.n
    if low == high:
        return {r: low for r in wanted if below <= r < below + inside}
    held = np.sort(np.array([r.v for r in v.filter(F.col("v").between(low, high)).collect()]))
    return {r: float(held[r - below]) for r in wanted if below <= r < below + len(held)}


def mean_over(data: DataFrame, by: list[str], value: str) -> DataFrame:
    return data.groupBy(*by).agg(F.avg(value).alias(value))


def weighted_mean(v: Column, w: Column | None) -> Column:
    if w is None:
        return F.avg(v)
    return F.try_divide(F.sum(w * v), F.sum(F.when(v.isNotNull(), w)))


def crop_missing(stack: DataFrame, value: str, slice_filter: Column | None = None) -> DataFrame:
    """The stack within the rows and columns between the first and last ones with a value (of one slice, if given)."""
    there = stack.filter(F.col(value).isNotNull())
    if slice_filter is not None:
        there = there.filter(slice_filter)
    box = F.broadcast(bounds(there))
    cols = stack.columns
    return stack.join(box, (F.col("x") >= F.col("minx")) & (F.col("x") <= F.col("maxx")) & (F.col("y") >= F.col("miny")) & (F.col("y") <= F.col("maxy"))).select(*cols)


def clip(stack: DataFrame, minx: float, miny: float, maxx: float, maxy: float, x: str = "x", y: str = "y") -> DataFrame:
    return stack.filter(F.col(x).between(minx, maxx) & F.col(y).between(miny, maxy))


def clip_polygon(stack: DataFrame, ring: list[tuple[float, float]], buffer: float = 0.0, x: str = "x", y: str = "y") -> DataFrame:
    """Rows inside a polygon (its corners as (x, y), closed or not), or within ``buffer`` of its border.

    An expression over the corners, so that the data are filtered where they lie; the bounding box goes to the scan.
    """
    corners = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring
    if len(corners) < 3:
        raise ValueError("a polygon has three corners or more")
    px, py = F.col(x), F.col(y)
    crossings, near = F.lit(0), F.lit(False)
    for (xa, ya), (xb, yb) in zip(corners, [*corners[1:], corners[0]], strict=True):
        if ya != yb:  # a ray to the right meets the edge
            meets = ((F.lit(ya) > py) != (F.lit(yb) > py)) & (px < (xb - xa) * (py - ya) / (yb - ya) + xa)
            crossings = crossings + meets.cast("int")
        if buffer > 0:
            length = (xb - xa) ** 2 + (yb - ya) ** 2
            t = F.least(F.greatest(((px - xa) * (xb - xa) + (py - ya) * (yb - ya)) / length, F.lit(0.0)), F.lit(1.0)) if length else F.lit(0.0)
            dx, dy = px - (xa + t * (xb - xa)), py - (ya + t * (yb - ya))
            near = near | (dx * dx + dy * dy <= buffer * buffer)
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    box = px.between(min(xs) - buffer, max(xs) + buffer) & py.between(min(ys) - buffer, max(ys) + buffer)
    return stack.filter(box & ((crossings % 2 == 1) | near))


def threshold(data: DataFrame, value: str, least: float, by: str) -> DataFrame:
    """``value`` kept where ``by`` reaches ``least``, NULL elsewhere."""
    return data.withColumn(value, F.when(F.col(by) >= least, F.col(value)))


def group_merge(catalog: DataFrame) -> DataFrame:
    """One row for each date of a scene catalog: subswaths joined to one number, paths collected in subswath order."""
    s = F.sort_array(F.collect_list(F.struct("subswath", "path")))
    return catalog.groupBy("date").agg(F.min("datetime").alias("datetime"), F.first("orbit").alias("orbit"), F.array_join(F.transform(s, lambda r: r["subswath"].cast("string")), "").cast("int").alias("subswath"), F.transform(s, lambda r: r["path"]).alias("path"))
