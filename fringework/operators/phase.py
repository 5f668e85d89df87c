"""Interferograms: phase differences of scene pairs, coherence, adaptive filtering, topographic phase."""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringework.functions import columns as C
from fringework.functions.columns import SPEED_OF_LIGHT
from fringework.operators import raster
from fringework.operators.pairs import pair_name
from fringework.operators.raster import Grid


def phase_difference(pairs: DataFrame, scenes: DataFrame, model: DataFrame | None = None, topo: DataFrame | None = None) -> DataFrame:
    """S1 * topo * exp(-i model) * conj(S2) for each pair and pixel: ``pair, ref, rep, y, x, re, im``.

    ``scenes``: date, y, x, re, im. ``model`` (pair, y, x, phase) and ``topo`` (pair, y, x, re, im) are optional. The pair
    table is small, so each pixel row finds its pairs by a broadcast join; the two roles then meet by (pair, y, x) in one
    shuffle that later per-pair steps reuse.
    """
    p = pairs.select("ref", "rep").distinct().withColumn("pair", pair_name())
    one = scenes.select(F.col("date").alias("ref"), "y", "x", C.c_new("re", "im").alias("s1"))
    two = scenes.select(F.col("date").alias("rep"), "y", "x", C.c_new("re", "im").alias("s2"))
    out = one.join(F.broadcast(p), "ref").join(two.join(F.broadcast(p.select("rep", "pair")), "rep").drop("rep"), ["pair", "y", "x"])
    product = C.c_mul(F.col("s1"), C.c_conj(F.col("s2")))
    if model is not None:
        out = out.join(model.select("pair", "y", "x", F.col("phase").alias("m")), ["pair", "y", "x"])
        product = C.c_mul(product, C.c_exp(-F.col("m")))
    if topo is not None:
        out = out.join(topo.select("pair", "y", "x", C.c_new("re", "im").alias("t")), ["pair", "y", "x"])
        product = C.c_mul(product, F.col("t"))
    return out.select("pair", "ref", "rep", "y", "x", product.alias("c")).select("pair", "ref", "rep", "y", "x", "c.re", "c.im")


def intensities(scenes: DataFrame) -> DataFrame:
    return scenes.select("date", "y", "x", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("intensity"))


def coherence(diff: DataFrame, intensity: DataFrame) -> DataFrame:
    """``correlation`` of each pair and pixel from the product and both scenes' intensities."""
    i1 = intensity.select(F.col("date").alias("ref"), "y", "x", F.col("intensity").alias("i1"))
    i2 = intensity.select(F.col("date").alias("rep"), "y", "x", F.col("intensity").alias("i2"))
    rows = diff.join(i1, ["ref", "y", "x"]).join(i2, ["rep", "y", "x"])
    return rows.select("pair", "ref", "rep", "y", "x", "re", "im", C.coherence(C.c_new("re", "im"), F.col("i1"), F.col("i2")).alias("correlation"))


def interferogram(diff: DataFrame, *keep: str) -> DataFrame:
    return diff.select("pair", "ref", "rep", "y", "x", F.atan2("im", "re").alias("phase"), *keep)


def triangle(size: tuple[int, int]) -> np.ndarray:
    """Separable weight that rises to the middle of a patch and falls after it."""

    def ramp(n: int) -> np.ndarray:
        half = 1 - np.abs(np.arange(n // 2) - (n / 2 - 1)) / (n / 2 - 1)
        return np.concatenate([half, half[::-1]])

    return np.outer(ramp(size[0]), ramp(size[1]))


def goldstein(diff: DataFrame, psize: int | tuple[int, int] = 32, grid: Grid | None = None, tile: int = 256) -> DataFrame:
    """Adaptive spectral filter of ``re, im`` by ``correlation`` for each pair.

    Patches of ``psize`` start at every half patch; each spectrum is multiplied by its modulus to the power 1 - mean
    correlation, and patches add up under triangular weights. Missing samples count as 0; a result of 0 is missing.
    """
    py, px = psize if isinstance(psize, tuple) else (psize, psize)
    g = grid or Grid.of(diff)
    w = triangle((py, px))
    sy, sx = py // 2, px // 2
    halo = max(py, px)

    def kernel(arrays: list[np.ndarray], y0: int, x0: int) -> list[np.ndarray]:
        re, im, corr = (np.nan_to_num(a) for a in arrays)
        data, out = re + 1j * im, np.zeros(re.shape, complex)
        for i in range(-(-y0 // sy) * sy, min(g.ny - py, y0 + re.shape[0] - py + 1), sy):
            for j in range(-(-x0 // sx) * sx, min(g.nx - px, x0 + re.shape[1] - px + 1), sx):
                part = np.s_[i - y0 : i - y0 + py, j - x0 : j - x0 + px]
                if data[part].any():
                    alpha = 1 - (w * corr[part]).sum() / w.sum()
                    spectrum = np.fft.fft2(data[part])
                    out[part] += w * np.fft.ifft2(spectrum * np.abs(spectrum) ** alpha)
        gone = out == 0
        return [np.where(gone, np.nan, out.real), np.where(gone, np.nan, out.imag)]

    done = raster.on_tiles(diff, ["pair", "ref", "rep"], ["re", "im", "correlation"], ["re", "im"], kernel, halo, g, max(tile, halo))
    return done


def topographic_phase(topo: DataFrame, pairs: DataFrame, first: Mapping[str, float], second: DataFrame) -> DataFrame:
    """exp(i topographic phase) of each pair: ``pair, ref, rep, y, x, re, im``.

    ``topo``: y, x, topo. ``first``: numbers of the common geometry (near_range, rng_samp_rate, stretch_r, a_stretch_r,
    earth_radius, SC_height, SC_height_start, SC_height_end, num_lines, PRF, wavelength). ``second``: one row for each pair
    with baseline_start/center/end, alpha_start/center/end (degrees), B_offset_start/center/end and tspan (seconds).
    Everything is column arithmetic after a broadcast join of the pair rows.
    """
    p = first
    ends = second.select(
        "ref",
        "rep",
        "tspan",
        *((F.col(f"baseline_{k}") * F.cos(F.radians(f"alpha_{k}"))).alias(f"h_{k}") for k in ("start", "center", "end")),
        *((F.col(f"baseline_{k}") * F.sin(F.radians(f"alpha_{k}"))).alias(f"v_{k}") for k in ("start", "center", "end")),
        *(F.col(f"B_offset_{k}").alias(f"x_{k}") for k in ("start", "center", "end")),
        ((F.col("baseline_center") != 0) | (F.col("alpha_center") != 0) | (F.col("B_offset_center") != 0)).alias("quadratic"),
    )
    rows = topo.filter("topo IS NOT NULL").join(F.broadcast(pairs.select("ref", "rep").distinct().join(ends, ["ref", "rep"])), F.lit(True))
    t = F.col("y") * F.col("tspan") / F.lit(float(p["num_lines"] - 1))

    def along(c: str) -> Column:
        a, m, z, s = F.col(f"{c}_start"), F.col(f"{c}_center"), F.col(f"{c}_end"), F.col("tspan")
        curve = a + (-3 * a + 4 * m - z) / s * t + (2 * a - 4 * m + 2 * z) / (s * s) * t * t
        return F.when(F.col("quadratic"), curve).otherwise(a + (z - a) / s * t)

    h0, hc, h1 = float(p["SC_height_start"]), float(p["SC_height"]), float(p["SC_height_end"])
    s = F.col("tspan")
    height = h0 + (-3 * h0 + 4 * hc - h1) / s * t + (2 * h0 - 4 * hc + 2 * h1) / (s * s) * t * t
    step = SPEED_OF_LIGHT / (2 * p["rng_samp_rate"])
    rho = p["near_range"] + F.col("x") * ((1 + p["stretch_r"]) * step) + F.col("y") * (p["a_stretch_r"] * step)
    rows = rows.select("ref", "rep", "y", "x", "topo", along("h").alias("bh"), along("v").alias("bv"), along("x").alias("bx"), height.alias("height"), rho.alias("rho"))
    c, r = F.lit(float(p["earth_radius"])) + F.col("height"), F.lit(float(p["earth_radius"])) + F.col("topo")
    cos_look = (F.col("rho") * F.col("rho") + c * c - r * r) / (2 * F.col("rho") * c)
    rows = rows.withColumns({"ct": cos_look}).withColumn("st", F.sqrt(1 - F.col("ct") * F.col("ct")))
    b = F.sqrt(F.col("bh") * F.col("bh") + F.col("bv") * F.col("bv"))
    alpha = F.atan2("bv", "bh")
    inside = F.col("rho") * F.col("rho") + b * b - 2 * F.col("rho") * b * (F.col("st") * F.cos(alpha) - F.col("ct") * F.sin(alpha)) - F.col("bx") * F.col("bx")
    angle = F.lit(-4 * math.pi / p["wavelength"]) * (F.sqrt(inside) - F.col("rho"))
    return rows.select("ref", "rep", pair_name().alias("pair"), "y", "x", F.cos(angle).alias("re"), F.sin(angle).alias("im"))


def compute(
    pairs: DataFrame,
    scenes: DataFrame,
    wavelength: float | None = None,
    factor: tuple[int, int] | None = None,
    spacing: tuple[float, float] = (1.0, 1.0),
    psize: int | None = None,
    weight: str | None = None,
    topo: DataFrame | None = None,
    model: DataFrame | None = None,
    resolution: float | None = None,
) -> DataFrame:
    """Phase and correlation of all pairs as one lazy plan: multilooked intensities, phase difference, multilook, coherence,
    optional adaptive filter, angle, optional decimation to ``resolution``. Returns ``pair, ref, rep, y, x, phase, correlation``."""
    g = Grid.of(scenes)
    looks = factor is not None or wavelength is not None
    i = intensities(scenes)
    d = phase_difference(pairs, scenes, model, topo)
    if looks:
        i = raster.multilook(i, ["intensity"], ["date"], wavelength, factor, spacing, grid=g)
        d = raster.multilook(d, ["re", "im"], ["pair", "ref", "rep"], wavelength, factor, spacing, grid=g)
    c = coherence(d, i)
    if psize:
        keys = ["pair", "ref", "rep", "y", "x"]
        c = goldstein(c, psize).join(c.select(*keys, "correlation"), keys)
    out = interferogram(c, "correlation")
    if resolution is not None:
        own = tuple(s * (k if factor else 1) for s, k in zip(spacing, factor or (1, 1), strict=True))
        block = tuple(max(1, round(resolution / s)) for s in own)
        out = raster.coarsen(out, block, ["phase", "correlation"], "mean", ("pair", "ref", "rep"))
    return out


def single_look(pairs: DataFrame, scenes: DataFrame, **options) -> DataFrame:
    return compute(pairs, scenes, factor=None, **options)


def multi_look(pairs: DataFrame, scenes: DataFrame, factor: tuple[int, int] = (1, 4), **options) -> DataFrame:
    return compute(pairs, scenes, factor=factor, **options)
