"""Neighbourhood operators on regular grids in long form (slice keys, y, x, values; missing is NULL).

Kernels that need a dense array work on tiles with a halo: each cell goes to its own tile and to those whose halo it lies
in, one shuffle, and each tile is a NumPy array in ``applyInPandas``. The rest are joins and aggregations.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fringework import shared
from fringework.functions.geometry import gaussian_1d
from fringework.operators import components

AGGREGATES = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "median": F.median, "first": F.first, "std": F.stddev_pop, "count": F.count}


@dataclass(frozen=True)
class Grid:
    """A regular grid: first coordinate, step and size of both axes."""

    y0: float
    dy: float
    ny: int
    x0: float
    dx: float
    nx: int

    @classmethod
    def of(cls, data: DataFrame, y: str = "y", x: str = "x") -> Grid:
        """From the distinct coordinates of each axis, which are few next to the cells."""

        def axis(c: str) -> tuple[float, float, int]:
            v = data.select(F.col(c).cast("double").alias("v")).distinct()
            gaps = v.withColumn("gap", F.col("v") - F.lag("v").over(Window.orderBy("v")))
            low, high, step = gaps.agg(F.min("v"), F.max("v"), F.min("gap")).first()
            step = step or 1.0
            return (low or 0.0), step, 0 if low is None else round((high - low) / step) + 1

        return cls(*axis(y), *axis(x))

    def iy(self, c: Column | str = "y") -> Column:
        return F.round((F.col(c) if isinstance(c, str) else c) / self.dy - self.y0 / self.dy).cast("int")

    def ix(self, c: Column | str = "x") -> Column:
        return F.round((F.col(c) if isinstance(c, str) else c) / self.dx - self.x0 / self.dx).cast("int")

    def y(self, i: Column) -> Column:
        return F.lit(self.y0) + i * self.dy

    def x(self, i: Column) -> Column:
        return F.lit(self.x0) + i * self.dx


# ---- blocks


def coarsen(data: DataFrame, factor: tuple[int, int], values: list[str], func: str = "mean", keys: tuple[str, ...] = (), pad: bool = False, grid: Grid | None = None) -> DataFrame:
    """Blocks of ``factor`` cells reduced by ``func``; coordinates are the means of the block's. Blocks that the grid's end cuts
    off are left out unless ``pad``."""
    ky, kx = factor
    if ky <= 1 and kx <= 1:
        return data.select(*keys, "y", "x", *values)
    g = grid or Grid.of(data)
    agg = AGGREGATES[func]
    rows = data.select(*keys, g.iy().alias("iy"), g.ix().alias("ix"), *values)
    if not pad:
        rows = rows.filter((F.col("iy") < g.ny // ky * ky) & (F.col("ix") < g.nx // kx * kx))
    by, bx = F.floor(F.col("iy") / ky), F.floor(F.col("ix") / kx)
    out = rows.groupBy(*keys, by.alias("by"), bx.alias("bx")).agg(*(agg(v).alias(v) for v in values))
    last = lambda b, k, n: F.least(b * k + k, F.lit(n)) - 1
    mid_y = (F.col("by") * ky + last(F.col("by"), ky, g.ny)) / 2
    mid_x = (F.col("bx") * kx + last(F.col("bx"), kx, g.nx)) / 2
    return out.select(*keys, g.y(mid_y).alias("y"), g.x(mid_x).alias("x"), *values)


def decimator(factor: tuple[int, int], func: str = "mean") -> Callable[..., DataFrame]:
    """A function that coarsens any stack by ``factor`` with ``func``; the identity if no factor is over 1."""
    return lambda data, values, keys=(): coarsen(data, factor, values, func, keys)


# ---- tiles


def on_tiles(data: DataFrame, keys: list[str], values: list[str], out: list[str], kernel: Callable, halo: int, grid: Grid, tile: int = 256, kind: str = "double", own: str = "") -> DataFrame:
    """Apply ``kernel(arrays, y0, x0) -> arrays`` to every tile with its halo.

    ``arrays``: for each value a float64 array with NaN for missing cells, cut to the grid; y0, x0: the grid index of its
    first cell. Cells of the tile proper come back wherever a result isn't NaN.
    """
    shared.ship(data.sparkSession)
    ny, nx = grid.ny, grid.nx

    def tiles(i: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(i) - halo) / tile), F.floor((F.col(i) + halo) / tile)))

    rows = data.select(*keys, grid.iy().alias("iy"), grid.ix().alias("ix"), *(F.col(v).cast("double").alias(v) for v in values))
    rows = rows.withColumn("ty", tiles("iy")).withColumn("tx", tiles("ix"))
    rows = rows.filter((F.col("ty") >= 0) & (F.col("tx") >= 0) & (F.col("ty") <= (ny - 1) // tile) & (F.col("tx") <= (nx - 1) // tile))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(pdf["ty"].iloc[0]), int(pdf["tx"].iloc[0])
        ya, yb = max(0, ty * tile - halo), min(ny, (ty + 1) * tile + halo)
        xa, xb = max(0, tx * tile - halo), min(nx, (tx + 1) * tile + halo)
        iy, ix = pdf["iy"].to_numpy() - ya, pdf["ix"].to_numpy() - xa
        arrays = []
        for v in values:
            a = np.full((yb - ya, xb - xa), np.nan)
            a[iy, ix] = pdf[v].to_numpy(dtype=float, na_value=np.nan)
            arrays.append(a)
        there = np.zeros((yb - ya, xb - xa), bool)
        there[iy, ix] = True
        results = kernel(arrays, ya, xa)
        core = np.s_[ty * tile - ya : min(ny, (ty + 1) * tile) - ya, tx * tile - xa : min(nx, (tx + 1) * tile) - xa]
        keep = np.logical_or.reduce([~np.isnan(r[core]) for r in results]) | there[core]
        y, x = np.nonzero(keep)
        new = {k: pdf[k].iloc[0] for k in keys} | {"iy": y + ty * tile, "ix": x + tx * tile}
        return pd.DataFrame(new | {o: r[core][keep] for o, r in zip(out, results, strict=True)}, columns=[*keys, "iy", "ix", *out]) if len(y) else pd.DataFrame({c: [] for c in [*keys, "iy", "ix", *out]})

    fields = [f"`{k}` {data.schema[k].dataType.simpleString()}" for k in keys]
    schema = ", ".join([*fields, "iy int", "ix int", *(f"{o} {kind}" for o in out)])
    done = rows.groupBy(*keys, "ty", "tx").applyInPandas(run, schema)
    clean = lambda o: F.when(~F.isnan(o), F.col(o)).alias(o)
    return done.select(*keys, grid.y(F.col("iy")).alias("y"), grid.x(F.col("ix")).alias("x"), *(clean(o) for o in out))


def _convolved(a: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    reach = len(kernel) // 2
    pad = [(0, 0), (0, 0)]
    pad[axis] = (reach, reach)
    wide = np.pad(a, pad, mode="symmetric")
    n = a.shape[axis]
    return sum(k * np.take(wide, range(i, i + n), axis) for i, k in enumerate(kernel))


def smoothed(v: np.ndarray, w: np.ndarray | None, sigma: tuple[float, float], truncate: float = 4.0) -> np.ndarray:
    """sum(k w v) / sum(k w) over the cells with a value; edges reflect; NaN where the denominator is 0."""
    there = ~np.isnan(v)
    weight = there.astype(float) if w is None else np.where(there, np.nan_to_num(w), 0.0)
    top, bottom = np.where(there, v, 0.0) * weight, weight
    for axis, s in enumerate(sigma):
        k = gaussian_1d(s, truncate)
        top, bottom = _convolved(top, k, axis), _convolved(bottom, k, axis)
    return np.where(bottom > 1e-17, top / np.maximum(bottom, 1e-17), np.nan)


def gaussian(data: DataFrame, values: list[str], sigma: tuple[float, float], keys: list[str] | None = None, weight: str | None = None, truncate: float = 4.0, grid: Grid | None = None, tile: int = 256) -> DataFrame:
    """NULL-aware Gaussian smoothing of each value column (the two parts of a complex value are two columns)."""
    keys = keys or []
    g = grid or Grid.of(data)
    halo = math.ceil(truncate * max(sigma)) + 1
    names = [*values, weight] if weight else list(values)

    def kernel(arrays: list[np.ndarray], y0: int, x0: int) -> list[np.ndarray]:
        w = arrays[-1] if weight else None
        return [smoothed(a, w, sigma, truncate) for a in arrays[: len(values)]]

    return on_tiles(data, keys, names, list(values), kernel, halo, g, max(tile, halo))


def multilook(data: DataFrame, values: list[str], keys: list[str] | None = None, wavelength: float | None = None, factor: tuple[int, int] | None = None, spacing: tuple[float, float] = (1.0, 1.0), weight: str | None = None, grid: Grid | None = None) -> DataFrame:
    """Gaussian low-pass of sigma = wavelength / 5.3 / spacing (or factor / 5.3), then block means; neither given: unchanged."""
    if wavelength is None and factor is None:
        return data
    g = grid or Grid.of(data)
    sigma = tuple(wavelength / 5.3 / s for s in spacing) if wavelength is not None else tuple(f / 5.3 for f in factor)
    out = gaussian(data, values, sigma, keys, weight, grid=g)
    return coarsen(out, factor, values, "mean", tuple(keys or ()), grid=g) if factor else out


def two_stage_gaussian(data: DataFrame, value: str, wavelength: float, spacing: tuple[float, float], keys: list[str] | None = None, resolution: float = 60.0, truncate: float = 3.0) -> DataFrame:
    """Low-pass of a long wavelength: smooth and coarsen to ``resolution``, smooth there with the wavelength that is left, and
    take the nearest coarse cell back. Direct where that saves nothing (no coarsening, or wavelength <= 3 resolutions)."""
    keys = keys or []
    scale = tuple(max(1, round(resolution / s)) for s in spacing)
    g = Grid.of(data)
    if max(scale) <= 1 or wavelength / resolution <= 3:
        return gaussian(data, [value], tuple(wavelength / 5.3 / s for s in spacing), keys, truncate=truncate, grid=g)
    small = coarsen(gaussian(data, [value], tuple(resolution / 5.3 / s for s in spacing), keys, truncate=truncate, grid=g), scale, [value], "mean", tuple(keys), pad=True, grid=g)
    left = math.sqrt(wavelength**2 - resolution**2)
    cg = Grid(g.y0 + (scale[0] - 1) / 2 * g.dy, g.dy * scale[0], -(-g.ny // scale[0]), g.x0 + (scale[1] - 1) / 2 * g.dx, g.dx * scale[1], -(-g.nx // scale[1]))
    indexed = small.withColumn("y", cg.y(F.floor(g.iy() / scale[0]))).withColumn("x", cg.x(F.floor(g.ix() / scale[1])))
    low = gaussian(indexed, [value], tuple(left / 5.3 / (s * k) for s, k in zip(spacing, scale, strict=True)), keys, truncate=truncate, grid=cg)
    low = low.select(*keys, cg.iy().alias("by"), cg.ix().alias("bx"), F.col(value).alias("low"))
    cells = data.select(*keys, "y", "x", F.floor(g.iy() / scale[0]).cast("int").alias("by"), F.floor(g.ix() / scale[1]).cast("int").alias("bx"))
    return cells.join(low, [*keys, "by", "bx"], "left").select(*keys, "y", "x", F.col("low").alias(value))


# ---- masks

CROSS = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]


def _spread(mask: DataFrame, value: str, keys: list[str]) -> DataFrame:
    shifts = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in CROSS)))
    return mask.select(*keys, "iy", "ix", F.col(value).alias("v"), shifts.alias("s")).select(*keys, (F.col("iy") + F.col("s.a")).alias("iy"), (F.col("ix") + F.col("s.b")).alias("ix"), "v", ((F.col("s.a") == 0) & (F.col("s.b") == 0)).alias("own"))


def _morph(mask: DataFrame, value: str, keys: list[str], iterations: int, erode: bool, grid: Grid | None) -> DataFrame:
    g = grid or Grid.of(mask)
    m = mask.select(*keys, g.iy().alias("iy"), g.ix().alias("ix"), F.coalesce(F.col(value).cast("int"), F.lit(0)).alias("v"))
    for _ in range(iterations):
        hit = F.sum("v") == len(CROSS) if erode else F.max("v") == 1
        m = _spread(m, "v", keys).groupBy(*keys, "iy", "ix").agg(hit.cast("int").alias("v"), F.max("own").alias("own")).filter("own").drop("own")
    return m.select(*keys, g.y(F.col("iy")).alias("y"), g.x(F.col("ix")).alias("x"), (F.col("v") == 1).alias(value))


def erosion(mask: DataFrame, value: str = "mask", keys: list[str] | None = None, iterations: int = 1, grid: Grid | None = None) -> DataFrame:
    """Cells whose four neighbours and themselves are set; outside the grid nothing is."""
    return _morph(mask, value, keys or [], iterations, True, grid)


def dilation(mask: DataFrame, value: str = "mask", keys: list[str] | None = None, iterations: int = 1, grid: Grid | None = None) -> DataFrame:
    return _morph(mask, value, keys or [], iterations, False, grid)


def opening(mask: DataFrame, value: str = "mask", keys: list[str] | None = None, iterations: int = 1, grid: Grid | None = None) -> DataFrame:
    g = grid or Grid.of(mask)
    return dilation(erosion(mask, value, keys, iterations, g), value, keys, iterations, g)


def closing(mask: DataFrame, value: str = "mask", keys: list[str] | None = None, iterations: int = 1, grid: Grid | None = None) -> DataFrame:
    g = grid or Grid.of(mask)
    return erosion(dilation(mask, value, keys, iterations, g), value, keys, iterations, g)


def label(mask: DataFrame, value: str = "mask", keys: list[str] | None = None, grid: Grid | None = None) -> DataFrame:
    """4-neighbour components of the set cells: ``keys, y, x, label`` (the smallest cell number of the component).

    Runs of a row are nodes and overlaps of runs in neighbouring rows are edges, so the graph is far smaller than the grid.
    """
    keys = keys or []
    g = grid or Grid.of(mask)
    cells = mask.filter(F.col(value).cast("boolean")).select(*keys, g.iy().alias("iy"), g.ix().alias("ix"))
    w = Window.partitionBy(*keys, "iy").orderBy("ix")
    runs = cells.withColumn("run", F.col("ix") - F.row_number().over(w))
    spans = shared.materialise(runs.groupBy(*keys, "iy", "run").agg(F.min("ix").alias("a"), F.max("ix").alias("b")).withColumn("node", F.col("iy").cast("long") * g.nx + F.col("a")), "runs")
    up = spans.select(*keys, (F.col("iy") + 1).alias("iy"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("node").alias("node2"))
    met = spans.join(up, [*keys, "iy"]).filter((F.col("a") <= F.col("b2")) & (F.col("a2") <= F.col("b")))
    # Slices, which are few, are told apart by a number next to the cell number.
    size = g.ny * g.nx + 1
    if keys:
        numbered = shared.materialise(spans.select(*keys).distinct().withColumn("slice", F.row_number().over(Window.orderBy(*keys)).cast("long")), "slices")
        tagged = lambda df: df.join(numbered, keys)
    else:
        tagged = lambda df: df.withColumn("slice", F.lit(0).cast("long"))
    edges = tagged(met).select((F.col("slice") * size + F.col("node")).alias("a"), (F.col("slice") * size + F.col("node2")).alias("b"))
    star = components.stars(edges)
    labels = tagged(spans).select(*keys, "iy", "run", (F.col("slice") * size + F.col("node")).alias("n")).join(star, F.col("n") == F.col("node"), "left")
    labels = labels.select(*keys, "iy", "run", F.pmod(F.coalesce("root", "n"), F.lit(size)).alias("label"))
    return runs.join(labels, [*keys, "iy", "run"]).select(*keys, g.y(F.col("iy")).alias("y"), g.x(F.col("ix")).alias("x"), "label")


def main_component(labels: DataFrame, keys: list[str] | None = None, least: int = 0, value: str = "label") -> DataFrame:
    """Cells of the most frequent label of at least ``least`` of each slice; of equal ones, the lowest."""
    keys = keys or []
    n = labels.filter(F.col(value) >= least).groupBy(*keys, value).agg(F.count("*").alias("n"))
    if keys:
        top = n.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col(value))).alias(value))
    else:
        top = n.agg(F.max_by(value, F.struct("n", -F.col(value))).alias(value))
    return labels.join(F.broadcast(top) if not keys else top, [*keys, value], "left_semi")


# ---- nearest and interpolation


def fill_nearest(data: DataFrame, value: str, radius: int, keys: list[str] | None = None, grid: Grid | None = None) -> DataFrame:
    """Missing cells (rows with a NULL) take the nearest value closer than ``radius`` cells; of equal distances the one with the
    smallest (y, x). A radius of 0 changes nothing. Cells meet in buckets of ``radius`` cells."""
    if radius <= 0:
        return data
    keys = keys or []
    g = grid or Grid.of(data)
    rows = data.select(*keys, "y", "x", value, g.iy().alias("iy"), g.ix().alias("ix"))
    near = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in itertools.product((-1, 0, 1), repeat=2)))
    holes = rows.filter(F.col(value).isNull()).select(*keys, "iy", "ix", F.explode(near).alias("s"))
    holes = holes.select(*keys, "iy", "ix", (F.floor(F.col("iy") / radius) + F.col("s.a")).alias("by"), (F.floor(F.col("ix") / radius) + F.col("s.b")).alias("bx"))
    known = rows.filter(F.col(value).isNotNull()).select(*keys, F.floor(F.col("iy") / radius).alias("by"), F.floor(F.col("ix") / radius).alias("bx"), F.col("iy").alias("ky"), F.col("ix").alias("kx"), F.col(value).alias("new"))
    d = (F.col("iy") - F.col("ky")) * (F.col("iy") - F.col("ky")) + (F.col("ix") - F.col("kx")) * (F.col("ix") - F.col("kx"))
    best = holes.join(known, [*keys, "by", "bx"]).withColumn("d", d).filter(F.col("d") < radius * radius).groupBy(*keys, "iy", "ix").agg(F.min_by("new", F.struct("d", "ky", "kx")).alias("new"))
    return rows.join(best, [*keys, "iy", "ix"], "left").select(*keys, "y", "x", F.coalesce(value, "new").alias(value))


def nearest_join(points: DataFrame, table: DataFrame, values: list[str], bound: float, px: str = "x", py: str = "y") -> DataFrame:
    """Each point with the values of the nearest table row closer than ``bound`` (NULL if none), found in buckets of that size."""
    p = points.withColumn("_p", F.monotonically_increasing_id())
    p = shared.materialise(p, "points")
    near = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in itertools.product((-1, 0, 1), repeat=2)))
    wide = p.select("_p", F.col(py).alias("_y"), F.col(px).alias("_x"), F.explode(near).alias("s"))
    wide = wide.select("_p", "_y", "_x", (F.floor(F.col("_y") / bound) + F.col("s.a")).alias("_by"), (F.floor(F.col("_x") / bound) + F.col("s.b")).alias("_bx"))
    t = table.select(F.floor(F.col("y") / bound).alias("_by"), F.floor(F.col("x") / bound).alias("_bx"), F.col("y").alias("_ty"), F.col("x").alias("_tx"), F.struct(*values).alias("_v"))
    d = (F.col("_y") - F.col("_ty")) ** 2 + (F.col("_x") - F.col("_tx")) ** 2
    best = wide.join(t, ["_by", "_bx"]).withColumn("_d", d).filter(F.col("_d") < bound * bound).groupBy("_p").agg(F.min_by("_v", F.struct("_d", "_ty", "_tx")).alias("_v"))
    return p.join(best, "_p", "left").select(*points.columns, *(F.col(f"_v.{v}").alias(v) for v in values))


def nearest_point(data: DataFrame, y: float, x: float, values: list[str], keys: list[str] | None = None) -> DataFrame:
    """The values of the cell nearest to (y, x), for each slice."""
    d = F.struct((F.col("y") - y) * (F.col("y") - y) + (F.col("x") - x) * (F.col("x") - x), "y", "x")
    return data.groupBy(*(keys or [])).agg(F.min_by(F.struct("y", "x", *values), d).alias("s")).select(*(keys or []), "s.*")


def _weights(f: Column, method: str) -> tuple[int, Column]:
    """The first offset from the cell below, and the weights from there on, of an interpolation at fraction ``f``."""
    if method == "linear":
        return 0, F.array(1 - f, f)
    if method == "cubic":
        a = -0.75
        near = lambda t: ((a + 2) * t - (a + 3)) * t * t + 1
        far = lambda t: ((a * t - 5 * a) * t + 8 * a) * t - 4 * a
        return -1, F.array(far(1 + f), near(f), near(1 - f), far(2 - f))
    if method == "lanczos":

        def sinc(t: Column) -> Column:
            return F.when(F.abs(t) < 1e-9, F.lit(1.0)).otherwise(F.sin(math.pi * t) * F.sin(math.pi * t / 4) * 4 / (math.pi * math.pi * t * t))

        raw = F.transform(F.array(*(F.lit(float(k)) for k in range(-3, 5))), lambda k: sinc(f - k))
        total = F.aggregate(raw, F.lit(0.0), lambda x, y: x + y)
        return -3, F.transform(raw, lambda w: w / total)
    raise ValueError(f"no interpolation named {method}")


def regrid(data: DataFrame, value: str, source: Grid, target: DataFrame, method: str = "linear", keys: list[str] | None = None) -> DataFrame:
    """Values at the target's (y, x): ``nearest``, ``linear``, ``cubic`` or ``lanczos``; borders reflect. A missing cell among those used gives NULL."""
    keys = keys or []
    fy, fx = (F.col("y") - source.y0) / source.dy, (F.col("x") - source.x0) / source.dx
    cells = data.select(*keys, source.iy().alias("iy"), source.ix().alias("ix"), F.col(value).cast("double").alias("v"))
    inside = fy.between(-0.5, source.ny - 0.5) & fx.between(-0.5, source.nx - 0.5)
    spots = target.select("y", "x").distinct().filter(inside)
    if method == "nearest":
        spots = spots.select("y", "x", F.least(F.greatest(F.round(fy), F.lit(0)), F.lit(source.ny - 1)).cast("int").alias("iy"), F.least(F.greatest(F.round(fx), F.lit(0)), F.lit(source.nx - 1)).cast("int").alias("ix"))
        return spots.join(cells, ["iy", "ix"]).select(*keys, "y", "x", F.col("v").alias(value))

    def reflected(i: Column, n: int) -> Column:
        return F.when(i < 0, -i - 1).when(i >= n, F.lit(2 * n - 1) - i).otherwise(i).cast("int")

    def taps(f: Column, n: int) -> Column:
        first, weights = _weights(f - F.floor(f), method)
        return F.explode(F.transform(weights, lambda w, k: F.struct(reflected(F.floor(f).cast("int") + first + k, n).alias("i"), w.alias("w"))))

    many = {"linear": 4, "cubic": 16, "lanczos": 64}[method]
    spots = spots.withColumn("a", taps(fy, source.ny)).withColumn("b", taps(fx, source.nx))
    spots = spots.select("y", "x", F.col("a.i").alias("iy"), F.col("b.i").alias("ix"), (F.col("a.w") * F.col("b.w")).alias("w"))
    out = spots.join(cells, ["iy", "ix"]).groupBy(*keys, "y", "x").agg(F.sum(F.col("w") * F.col("v")).alias(value), F.count("v").alias("n"))
    return out.select(*keys, "y", "x", F.when(F.col("n") == many, F.col(value)).alias(value))


def same_grid(data: DataFrame, grid: Grid, target: DataFrame, values: list[str], keys: list[str] | None = None) -> DataFrame:
    """The nearest cell of ``data`` for each target cell: an equi-join on computed indexes."""
    t = target.select("y", "x").distinct().select("y", "x", grid.iy().alias("iy"), grid.ix().alias("ix"))
    d = data.select(*(keys or []), grid.iy().alias("iy"), grid.ix().alias("ix"), *values)
    return t.join(d, ["iy", "ix"]).select(*(keys or []), "y", "x", *values)


def slope_degrees(topo: DataFrame, value: str = "topo", spacing: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Slope from central differences (one-sided at the edges)."""

    def gradient(axis: str, other: str, step: float) -> Column:
        w = Window.partitionBy(other).orderBy(axis)
        before, after = F.lag(value).over(w), F.lead(value).over(w)
        return F.coalesce((after - before) / (2 * step), (after - F.col(value)) / step, (F.col(value) - before) / step)

    g = topo.select("y", "x", value, gradient("y", "x", spacing[0]).alias("gy"), gradient("x", "y", spacing[1]).alias("gx"))
    return g.select("y", "x", F.degrees(F.atan(F.sqrt(F.col("gy") * F.col("gy") + F.col("gx") * F.col("gx")))).alias("slope"))


def variation(grid: DataFrame, value: str) -> DataFrame:
    """First difference along x over its mean."""
    w = Window.partitionBy("y").orderBy("x")
    d = grid.select("y", "x", (F.col(value) - F.lag(value).over(w)).alias("d"))
    mean = F.broadcast(d.agg(F.avg("d").alias("m")))
    return d.join(mean, F.lit(True)).select("y", "x", F.try_divide("d", "m").alias("variation")).filter("variation IS NOT NULL")


def stride(data: DataFrame, grid: Grid, ky: int, kx: int) -> DataFrame:
    """Every ky-th row and kx-th column."""
    return data.filter((grid.iy() % ky == 0) & (grid.ix() % kx == 0))
