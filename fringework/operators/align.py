"""Alignment of a repeat scene with its reference: offsets between their geometries, shifts from a fit, resampling."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringework.operators import raster
from fringework.operators.raster import Grid


def offsets_between(reference: DataFrame, repeat: DataFrame, snr: float = 100.0) -> DataFrame:
    """Offsets ``range, d_range, azimuth, d_azimuth, snr`` at the ground points (lat, lon) that both transform tables see.

    An equi-join on the points of one height model; ``snr`` stands for that of offsets that geometry gives.
    """
    two = repeat.select("lat", "lon", F.col("rng").alias("r2"), F.col("azi").alias("a2"))
    return reference.join(two, ["lat", "lon"]).select(F.col("rng").alias("range"), (F.col("r2") - F.col("rng")).alias("d_range"), F.col("azi").alias("azimuth"), (F.col("a2") - F.col("azi")).alias("d_azimuth"), F.lit(float(snr)).alias("snr"))


def fitted_shifts(cells: DataFrame, fit: Mapping[str, float]) -> DataFrame:
    """``y, x, dy, dx`` of cells by the shifts and stretches that ``regression.fit_offsets`` found."""
    plane = lambda whole, part, by_x, by_y: F.lit(fit[whole] + fit[part]) + F.lit(fit[by_x]) * F.col("x") + F.lit(fit[by_y]) * F.col("y")
    return cells.select("y", "x", plane("ashift", "sub_int_a", "stretch_a", "a_stretch_a").alias("dy"), plane("rshift", "sub_int_r", "stretch_r", "a_stretch_r").alias("dx"))


def resampled(data: DataFrame, values: list[str], shifts: DataFrame, grid: Grid, method: str = "linear", keys: list[str] | None = None) -> DataFrame:
    """Values (the two parts of complex samples are two) of a scene at its cells moved by ``shifts`` (y, x, dy, dx).

    Positions outside the grid have no row; where a cell among those used is missing, the value is NULL.
    """
    keys = keys or []
    spots = shifts.select(F.col("y").alias("own_y"), F.col("x").alias("own_x"), (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"))
    out = spots
    for v in values:
        out = out.join(raster.regrid(data, v, grid, spots, method, keys), [*(keys if out is not spots else []), "y", "x"])
    return out.select(*keys, F.col("own_y").alias("y"), F.col("own_x").alias("x"), *values)
