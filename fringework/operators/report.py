"""The history of one place: displacement, its line and seasons, and how well the pairs agree with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringework.functions import columns as C
from fringework.operators import inversion, raster, regression, stats, stl


def displacement_report(data: DataFrame, y: float, x: float, wavelength: float | None = None, weight: str | None = None, unwrap: bool = True, freq: str | None = None, period: int = 52, pairs: DataFrame | None = None) -> DataFrame:
    """``date, y, x, displacement, line, velocity, rmse[, trend, seasonal]`` at the pixel of ``data`` (ref, rep, y, x, phase
    [, weight]) nearest to (y, x).

    Its pairs are unwrapped in time (unless ``unwrap`` is false) and inverted to a history; ``line`` is the line through it,
    ``velocity`` that line's slope by year, ``rmse`` the residual of the pairs. With ``wavelength`` they are millimetres along
    the line of sight. ``freq`` adds the decomposition at regular dates, by the nearest date's; other dates have none.
    """
    near = raster.nearest_point(data, y, x, []).select("y", "x")
    own = data.join(F.broadcast(near), ["y", "x"], "left_semi")  # one pixel: as many rows as the network
    network = data.select("ref", "rep") if pairs is None else pairs
    if unwrap:
        values = inversion.unwrap1d(own, "phase", weight, pairs=network).select("ref", "rep", "y", "x", "phase")
        own = values.join(own.drop("phase"), ["ref", "rep", "y", "x"]) if weight else values
    history = inversion.lstsq(own, "phase", weight, pairs=network)
    rmse = stats.residual_rmse(own.select("ref", "rep", "y", "x", "phase", *([weight] if weight else [])), history, weight=weight)
    day = regression.days("date")
    fit = history.groupBy("y", "x").agg(F.regr_slope(F.col("displacement").cast("double"), day).alias("b"), F.regr_intercept(F.col("displacement").cast("double"), day).alias("a"))
    out = history.join(F.broadcast(fit), ["y", "x"]).join(F.broadcast(rmse), ["y", "x"], "left")
    scale = (lambda c: C.los_displacement_mm(c, wavelength)) if wavelength else (lambda c: c)
    size = F.abs(scale(F.lit(1.0))) if wavelength else F.lit(1.0)
    out = out.select("date", "y", "x", scale(F.col("displacement").cast("double")).alias("displacement"), scale(F.col("a") + F.col("b") * day).alias("line"), scale(F.col("b") * regression.YEAR).alias("velocity"), (F.col("rmse") * size).alias("rmse"))
    if freq is None:
        return out
    parts = stl.stl(out.select("date", "y", "x", "displacement"), "displacement", freq, period)
    return out.join(parts.select("date", "y", "x", "trend", "seasonal"), ["date", "y", "x"], "left")
