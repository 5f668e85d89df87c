"""Between radar and geographic coordinates: transform tables, lookups, look vectors, tides."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringework import shared
from fringework.functions import columns as C
from fringework.functions import geometry
from fringework.functions.columns import SPEED_OF_LIGHT
from fringework.operators import raster
from fringework.operators.raster import Grid

EARTH_A, EARTH_F = 6378137.0, 1 / 298.257223563


def axis(spark: SparkSession, low: float, high: float, step: float, name: str) -> DataFrame:
    """Regular coordinates from low to high."""
    return spark.range(int(math.floor((high - low) / step)) + 1).select((F.lit(float(low)) + F.col("id") * float(step)).alias(name))


def trans_grid(spark: SparkSession, lines: int, bins: int, coarsen: tuple[float, float]) -> tuple[DataFrame, DataFrame]:
    """Azimuth and range axes of a transform table, clipped to the extent."""
    return tuple(axis(spark, c / 2, n, c, k) for n, c, k in ((lines, coarsen[0], "azi"), (bins, coarsen[1], "rng")))


def to_ecef(lon: np.ndarray, lat: np.ndarray, height: np.ndarray) -> np.ndarray:
    lam, phi = np.radians(lon), np.radians(lat)
    e2 = EARTH_F * (2 - EARTH_F)
    n = EARTH_A / np.sqrt(1 - e2 * np.sin(phi) ** 2)
    return np.stack([(n + height) * np.cos(phi) * np.cos(lam), (n + height) * np.cos(phi) * np.sin(lam), (n * (1 - e2) + height) * np.sin(phi)], -1)


class Orbit:
    """Positions and velocities at given seconds, interpolated by cubic Hermite polynomials."""

    def __init__(self, t: np.ndarray, position: np.ndarray, velocity: np.ndarray):
        order = np.argsort(t)
        self.t, self.p, self.v = np.asarray(t, float)[order], np.asarray(position, float)[order], np.asarray(velocity, float)[order]

    def __call__(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.clip(np.searchsorted(self.t, t, side="right") - 1, 0, len(self.t) - 2)
        h = (self.t[i + 1] - self.t[i])[..., None]
        s = (t - self.t[i])[..., None] / h
        p0, p1, m0, m1 = self.p[i], self.p[i + 1], self.v[i] * h, self.v[i + 1] * h
        place = (2 * s**3 - 3 * s**2 + 1) * p0 + (s**3 - 2 * s**2 + s) * m0 + (3 * s**2 - 2 * s**3) * p1 + (s**3 - s**2) * m1
        speed = ((6 * s**2 - 6 * s) * (p0 - p1) + (3 * s**2 - 4 * s + 1) * m0 + (3 * s**2 - 2 * s) * m1) / h
        return place, speed

    def zero_doppler(self, points: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
        """Time at which the line of sight to each point is square to the velocity, and the range then."""
        start = np.argmin(((points[:, None] - self.p[None, ::max(1, len(self.p) // 64)]) ** 2).sum(-1), 1)
        t = self.t[:: max(1, len(self.p) // 64)][start].copy()
        for _ in range(rounds):
            p, v = self(t)
            d = points - p
            step = (d * v).sum(-1) / (v * v).sum(-1)
            t = np.clip(t + step, self.t[0], self.t[-1])
            if np.abs(step).max(initial=0) < 1e-9:
                break
        p, _ = self(t)
        return t, np.sqrt(((points - p) ** 2).sum(-1))


#: State vectors that one model may hold: four months of them at 10 s.
MOST_VECTORS = 1_000_000


def orbit_model(orbit: DataFrame) -> Orbit:
    """The orbit of one scene as a model that is sent to the tasks. More than ``MOST_VECTORS`` state vectors are an error: such
    a table holds several scenes' orbits, of which ``around`` takes the ones of a scene."""
    if orbit.count() > MOST_VECTORS:
        raise ValueError(f"an orbit has at most {MOST_VECTORS} state vectors")
    rows = orbit.orderBy("clock").toPandas()
    return Orbit(rows["clock"].to_numpy(), rows[["px", "py", "pz"]].to_numpy(), rows[["vx", "vy", "vz"]].to_numpy())


def around(orbit: DataFrame, start: float, stop: float, margin: float = 600.0) -> DataFrame:
    """The state vectors from ``margin`` seconds before ``start`` to as many after ``stop`` (seconds)."""
    return orbit.filter(F.col("clock").between(start - margin, stop + margin))


def orbit_numbers(orbit: DataFrame, params: Mapping[str, float]) -> dict[str, float]:
    """What a scene's orbit says: speed, Earth radius below, and height over it at the middle, the start and the end of the scene.

    ``params``: clock_start (days), PRF and num_lines.
    """
    start = params["clock_start"] * 86400
    p, v = orbit_model(orbit)(start + np.array([0.5, 0.0, 1.0]) * params["num_lines"] / params["PRF"])
    height, below = geometry.ellipsoid_height(*p.T)
    names = zip(("SC_height", "SC_height_start", "SC_height_end"), height + below - below[0], strict=True)
    return {"SC_vel": float(np.sqrt((v[0] ** 2).sum())), "earth_radius": float(below[0])} | {k: float(h) for k, h in names}


def to_radar(points: DataFrame, orbit: DataFrame, params: Mapping[str, float], keep_outside: bool = False) -> DataFrame:
    """``rng, azi`` pixel coordinates (and ``slant`` metres) of rows with lon, lat and height ``ele`` by the zero-Doppler condition.

    ``orbit`` (clock, px..vz) has one row for each 10 s and is sent to the tasks; the points stay where they are. Rows
    outside ``num_lines`` x ``num_rng_bins`` go unless ``keep_outside``.
    """
    shared.ship(points.sparkSession)
    model = orbit_model(orbit)
    prf, t0 = params["PRF"], params["clock_start"] * 86400
    step = SPEED_OF_LIGHT / params["rng_samp_rate"] / 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            t, r = model.zero_doppler(to_ecef(b["lon"].to_numpy(float), b["lat"].to_numpy(float), b["ele"].to_numpy(float)))
            out = b.assign(azi=(t - t0) * prf, rng=(r - params["near_range"]) / step, slant=r)
            if not keep_outside:
                out = out[(out["azi"] >= 0) & (out["azi"] < params["num_lines"]) & (out["rng"] >= 0) & (out["rng"] < params["num_rng_bins"])]
            yield out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInPandas(run, f"{fields}, azi double, rng double, slant double")


def transform(dem: DataFrame, orbit: DataFrame, params: Mapping[str, float]) -> DataFrame:
    """The forward table ``lat, lon, azi, rng, ele`` of a height model (lat, lon, ele) within the scene."""
    return to_radar(dem.select("lat", "lon", "ele").filter("ele IS NOT NULL"), orbit, params).drop("slant")


def inverse(trans: DataFrame, target: DataFrame, coarsen: tuple[float, float]) -> DataFrame:
    """``y, x, lt, ll, ele`` at radar cells ``target`` (y, x): the nearest forward point within twice the larger step, else NULL."""
    table = trans.select(F.col("azi").alias("y"), F.col("rng").alias("x"), F.col("lat").alias("lt"), F.col("lon").alias("ll"), "ele")
    return raster.nearest_join(target.select("y", "x"), table, ["lt", "ll", "ele"], 2.0 * max(coarsen))


def inverse_bounds(inv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Latitude limits of each row and longitude limits of each column."""
    return inv.groupBy("y").agg(F.min("lt").alias("lt_min"), F.max("lt").alias("lt_max")), inv.groupBy("x").agg(F.min("ll").alias("ll_min"), F.max("ll").alias("ll_max"))


def topo_of(inv: DataFrame) -> DataFrame:
    return inv.select("y", "x", F.col("ele").alias("topo"))


def radar_to_geo(data: DataFrame, trans: DataFrame, values: list[str], grid: Grid, keys: list[str] | None = None) -> DataFrame:
    """Values at the transform's (lat, lon): each looks up the nearest radar cell; outside the grid there is no row."""
    t = trans.select("lat", "lon", grid.iy(F.col("azi")).alias("iy"), grid.ix(F.col("rng")).alias("ix"))
    t = t.filter(F.col("iy").between(0, grid.ny - 1) & F.col("ix").between(0, grid.nx - 1))
    d = data.select(*(keys or []), grid.iy().alias("iy"), grid.ix().alias("ix"), *values)
    return t.join(d, ["iy", "ix"]).select(*(keys or []), "lat", "lon", *values)


def geo_to_radar(data: DataFrame, inv: DataFrame, values: list[str], grid: Grid, keys: list[str] | None = None) -> DataFrame:
    """Values at radar cells (y, x): each looks up the nearest geographic cell of a grid (lat as y, lon as x)."""
    t = inv.select("y", "x", grid.iy(F.col("lt")).alias("iy"), grid.ix(F.col("ll")).alias("ix"))
    d = data.select(*(keys or []), grid.iy(F.col("lat")).alias("iy"), grid.ix(F.col("lon")).alias("ix"), *values)
    return t.join(d, ["iy", "ix"]).select(*(keys or []), "y", "x", *values)


def lookup_stride(own_step: float, table_step: float) -> tuple[int, int]:
    """How many table cells one cell spans, and where the first lookup lies."""
    k = max(1, round(own_step / table_step))
    return k, k // 2


def geocode_points(points: DataFrame, dem: DataFrame, grid: Grid, orbit: DataFrame, params: Mapping[str, float], z_offset: float | None = None) -> DataFrame:
    """Radar coordinates of vertices ``lon, lat[, z]``: heights from the model by bilinear interpolation unless given."""
    if "z" in points.columns and z_offset is None:
        rows = points.withColumn("ele", F.col("z"))
    else:
        model = dem.select(F.col("lat").alias("y"), F.col("lon").alias("x"), "ele")
        spots = points.select(F.col("lat").alias("y"), F.col("lon").alias("x"))
        ele = raster.regrid(model, "ele", grid, spots, "linear").select(F.col("y").alias("lat"), F.col("x").alias("lon"), (F.col("ele") + float(z_offset or 0)).alias("ele"))
        rows = points.join(ele, ["lat", "lon"])
    return to_radar(rows.filter("ele IS NOT NULL"), orbit, params, keep_outside=True)


def look_vectors(points: DataFrame, orbit: DataFrame) -> DataFrame:
    """Unit vectors ``look_E, look_N, look_U`` from each ground point (lon, lat, ele) to the satellite."""
    shared.ship(points.sparkSession)
    model = orbit_model(orbit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lon, lat = b["lon"].to_numpy(float), b["lat"].to_numpy(float)
            ground = to_ecef(lon, lat, b["ele"].to_numpy(float))
            t, r = model.zero_doppler(ground)
            d = (model(t)[0] - ground) / r[:, None]
            lam, phi = np.radians(lon), np.radians(lat)
            east = -np.sin(lam) * d[:, 0] + np.cos(lam) * d[:, 1]
            north = -np.sin(phi) * np.cos(lam) * d[:, 0] - np.sin(phi) * np.sin(lam) * d[:, 1] + np.cos(phi) * d[:, 2]
            up = np.cos(phi) * np.cos(lam) * d[:, 0] + np.cos(phi) * np.sin(lam) * d[:, 1] + np.sin(phi) * d[:, 2]
            yield b.assign(look_E=east, look_N=north, look_U=up)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInPandas(run, f"{fields}, look_E double, look_N double, look_U double")


# ---- solid Earth tides


def _sun_moon(day: float) -> list[tuple[np.ndarray, float]]:
    """Low-precision Earth-fixed places (metres) of Sun and Moon ``day`` days after 2000-01-01 12:00, with their mass ratios to the Earth."""
    rad = np.radians
    eps = rad(23.439 - 0.0000004 * day)
    g = rad((357.528 + 0.9856003 * day) % 360)
    lam = rad((280.460 + 0.9856474 * day) % 360 + 1.915 * np.sin(g) + 0.020 * np.sin(2 * g))
    sun = 149597870700.0 * (1.00014 - 0.01671 * np.cos(g) - 0.00014 * np.cos(2 * g)) * np.array([np.cos(lam), np.cos(eps) * np.sin(lam), np.sin(eps) * np.sin(lam)])
    long, anomaly, node = (rad((a + b * day) % 360) for a, b in ((218.316, 13.176396), (134.963, 13.064993), (93.272, 13.229350)))
    lam, beta = long + rad(6.289) * np.sin(anomaly), rad(5.128) * np.sin(node)
    r = 385000560.0 - 20905000.0 * np.cos(anomaly)
    x, y, z = r * np.cos(beta) * np.cos(lam), r * np.cos(beta) * np.sin(lam), r * np.sin(beta)
    moon = np.array([x, np.cos(eps) * y - np.sin(eps) * z, np.sin(eps) * y + np.cos(eps) * z])
    turn = rad((280.46061837 + 360.98564736629 * day) % 360)
    spin = np.array([[np.cos(turn), np.sin(turn), 0], [-np.sin(turn), np.cos(turn), 0], [0, 0, 1]])
    return [(spin @ sun, 332946.0), (spin @ moon, 0.0123000371)]


def tide(lon: np.ndarray, lat: np.ndarray, day: float) -> np.ndarray:
    """Degree-2 solid tide (east, north, up metres) with Love numbers 0.6078 and 0.0847."""
    ground = to_ecef(lon, lat, np.zeros(len(lon)))
    r = np.sqrt((ground**2).sum(1, keepdims=True))
    unit, out = ground / r, np.zeros_like(ground)
    for body, mass in _sun_moon(day):
        d = np.sqrt((body**2).sum())
        b = body / d
        c = unit @ b
        scale = mass * EARTH_A**4 / d**3
        out += scale * (0.6078 * unit * (1.5 * c**2 - 0.5)[:, None] + 3 * 0.0847 * c[:, None] * (b - c[:, None] * unit))
    lam, phi = np.radians(lon), np.radians(lat)
    east = -np.sin(lam) * out[:, 0] + np.cos(lam) * out[:, 1]
    north = -np.sin(phi) * np.cos(lam) * out[:, 0] - np.sin(phi) * np.sin(lam) * out[:, 1] + np.cos(phi) * out[:, 2]
    up = np.cos(phi) * np.cos(lam) * out[:, 0] + np.cos(phi) * np.sin(lam) * out[:, 1] + np.sin(phi) * out[:, 2]
    return np.stack([east, north, up], 1)


def tides(grid: DataFrame, times: DataFrame) -> DataFrame:
    """``date, y, x, lon, lat, dx, dy, dz`` for a coarse grid (y, x, lon, lat) and scene times (datetime), which are few."""
    shared.ship(grid.sparkSession)
    day = (F.unix_micros("datetime") / 86_400_000_000.0 - 10957.5).alias("day")
    rows = grid.join(F.broadcast(times.select(F.to_date("datetime").alias("date"), day)), F.lit(True)).select("date", "day", "y", "x", "lon", "lat")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.zeros((len(b), 3))
            for d in b["day"].unique():
                at = (b["day"] == d).to_numpy()
                out[at] = tide(b["lon"].to_numpy(float)[at], b["lat"].to_numpy(float)[at], d)
            yield b.drop(columns="day").assign(dx=out[:, 0], dy=out[:, 1], dz=out[:, 2])

    y, x = (grid.schema[c].dataType.simpleString() for c in "yx")
    return rows.mapInPandas(run, f"date date, y {y}, x {x}, lon double, lat double, dx double, dy double, dz double")


def tidal_los(pairs: DataFrame, tidal: DataFrame, look: DataFrame, grid: Grid) -> DataFrame:
    """Line-of-sight tide in metres, tide(rep) - tide(ref), of each pair at the pixels of ``look`` (y, x, look_E/N/U)."""
    parts = [raster.regrid(tidal.withColumnRenamed("date", "day_"), c, grid, look, "linear", ["day_"]).withColumnRenamed("day_", "date") for c in ("dx", "dy", "dz")]
    whole = parts[0].join(parts[1], ["date", "y", "x"]).join(parts[2], ["date", "y", "x"]).join(look, ["y", "x"])
    los = whole.select("date", "y", "x", C.los_projection(("look_E", "look_N", "look_U"), ("dx", "dy", "dz")).alias("los"))
    p = F.broadcast(pairs.select("ref", "rep").distinct())
    one = los.select(F.col("date").alias("ref"), "y", "x", F.col("los").alias("l1")).join(p, "ref")
    two = los.select(F.col("date").alias("rep"), "y", "x", F.col("los").alias("l2"))
    return one.join(two, ["rep", "y", "x"]).select("ref", "rep", "y", "x", (F.col("l2") - F.col("l1")).alias("tidal_los"))
