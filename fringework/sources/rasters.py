"""Raster sources: raw complex samples, orbit vectors, height models, land masks, map tiles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fringework import shared
from fringework.functions import columns as C
from fringework.functions.columns import missing
from fringework.operators import raster
from fringework.operators.raster import Grid


def read_samples(spark: SparkSession, path: str, width: int, shape: tuple[int, int] | None = None, scale: float = 2.5e-07) -> DataFrame:
    """Interleaved little-endian int16 re/im samples of ``width`` columns: ``path, y, x, re, im``; coordinates are index + 0.5.

    The file is split by Spark into records of a line each (fixed-length binary records), so lines of one file are read by
    many tasks. ``shape`` crops, or fills up with zeros, to (rows, columns). A sample of 0 is missing (NULL).
    """
    shared.ship(spark)
    rows, cols = shape or (None, width)
    raw = spark.sparkContext.newAPIHadoopFile(
        path, "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf={"fixedlengthinputformat.record.length": str(4 * width)}
    )
    lines = spark.createDataFrame(raw, "at long, raw binary").select((F.col("at") / (4 * width)).cast("long").alias("line"), "raw")
    if rows is not None:
        lines = lines.filter(F.col("line") < rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:  # many lines at once
            a = np.frombuffer(b"".join(b["raw"]), "<i2").reshape(len(b), width, 2)[:, :cols].astype(np.float32) * np.float32(scale)
            if width < cols:
                a = np.concatenate([a, np.zeros((len(b), cols - width, 2), np.float32)], 1)
            yield pd.DataFrame({"y": np.repeat(b["line"].to_numpy() + 0.5, cols), "x": np.tile(np.arange(cols) + 0.5, len(b)), "re": a[..., 0].reshape(-1), "im": a[..., 1].reshape(-1)})

    out = lines.mapInPandas(run, "y double, x double, re float, im float")
    if rows is not None:  # lines that the file doesn't have
        every = spark.range(rows).select((F.col("id") + 0.5).alias("y"))
        gone = every.join(lines.select((F.col("line") + 0.5).alias("y")), "y", "left_anti")
        fill = gone.select("y", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("i")).select("y", (F.col("i") + 0.5).alias("x"), F.lit(0.0).cast("float").alias("re"), F.lit(0.0).cast("float").alias("im"))
        out = out.unionByName(fill)
    there = (F.col("re") != 0) | (F.col("im") != 0)
    return out.select("y", "x", F.when(there, F.col("re")).alias("re"), F.when(there, F.col("im")).alias("im"))


def read_orbit(spark: SparkSession, path: str) -> DataFrame:
    """State vectors of an orbit file (a header line, then ``iy id isec px py pz vx vy vz``) with ``clock = 86400 id + isec``."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).filter(F.size("p") == 9)
    names = ("iy", "id", "isec", "px", "py", "pz", "vx", "vy", "vz")
    out = lines.select(*(F.col("p")[i].cast("double").alias(n) for i, n in enumerate(names)))
    return out.withColumn("clock", F.col("id") * 86400 + F.col("isec"))


def stitched(parts: DataFrame, offsets: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Subswaths of scenes (date, subswath, y, x, re, im) side by side in one grid by their offsets (date, subswath, bottom, left)."""
    out = parts.join(F.broadcast(offsets.select("date", "subswath", "bottom", "left")), ["date", "subswath"])
    out = out.select("date", (F.col("y") + F.col("bottom")).alias("y"), (F.col("x") + F.col("left")).alias("x"), "re", "im")
    if box is not None:
        out = out.filter(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3]))
    there = C.c_abs2(C.c_new("re", "im")) != 0
    return out.select("date", "y", "x", F.when(there, F.col("re")).alias("re"), F.when(there, F.col("im")).alias("im"))


def clean_model(model: DataFrame, value: str = "ele", box: tuple[float, float, float, float] | None = None, buffer: float = 0.02) -> DataFrame:
    """A height model as ``lat, lon, value``: coordinates to 8 digits, NaN missing, within a box and a buffer around it. Repeated
    coordinates are an error for the caller to see in ``repeated``."""
    out = model.select(F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"), missing(F.col(value).cast("double")).alias(value))
    if box is not None:
        out = out.filter(F.col("lon").between(box[0] - buffer, box[2] + buffer) & F.col("lat").between(box[1] - buffer, box[3] + buffer))
    return out


def repeated(model: DataFrame) -> DataFrame:
    return model.groupBy("lat", "lon").agg(F.count("*").alias("n")).filter("n > 1")


def over_ellipsoid(model: DataFrame, geoid: DataFrame, geoid_grid: Grid, value: str = "ele") -> DataFrame:
    """Heights over the ellipsoid: the model plus the geoid (lat, lon, geoid) interpolated to its cells."""
    g = geoid.select(F.col("lat").alias("y"), F.col("lon").alias("x"), "geoid")
    spots = model.select(F.col("lat").alias("y"), F.col("lon").alias("x"))
    at = raster.regrid(g, "geoid", geoid_grid, spots, "linear").select(F.col("y").alias("lat"), F.col("x").alias("lon"), "geoid")
    return model.join(at, ["lat", "lon"], "left").select("lat", "lon", (F.col(value) + F.col("geoid")).alias(value))


def land_mask(mask: DataFrame, value: str = "landmask") -> DataFrame:
    return mask.select(F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"), F.coalesce(missing(F.col(value).cast("double")), F.lit(0.0)).alias(value))


def mask_on(mask: DataFrame, grid: Grid, model: DataFrame, value: str = "landmask") -> DataFrame:
    """The mask at the cells of a height model: the nearest mask cell, an equi-join on indexes."""
    m = mask.select(F.col("lat").alias("y"), F.col("lon").alias("x"), value)
    out = raster.same_grid(m, grid, model.select(F.col("lat").alias("y"), F.col("lon").alias("x")), [value])
    return out.select(F.col("y").alias("lat"), F.col("x").alias("lon"), value)


# ---- map tiles

#: tile sources: address with {lat}, {lon} or {x}, {y}, {z}, file kind and resolution in degrees; fetching them is the caller's connector
PRESETS = {
    "landmask": ("{base}/landmask/1s/{lat}/{lat}{lon}.nc.zip", "netcdf"),
    "dem_glo": ("{base}/glo/{product}/{lat}_00_{lon}_00.tif", "geotiff"),
    "dem_srtm": ("{base}/srtm/1s/{lat}/{lat}{lon}.hgt.gz", "hgt"),
    "dem_alos": ("{base}/alos/{lat5}{lon5}/{lat}{lon}.tif", "geotiff"),
    "maps": ("{base}/lyrs=m&x={x}&y={y}&z={z}", "image"),
    "satellite": ("{base}/lyrs=s&x={x}&y={y}&z={z}", "image"),
    "satellite_hybrid": ("{base}/lyrs=y&x={x}&y={y}&z={z}", "image"),
    "openstreetmap": ("{base}/{z}/{x}/{y}.png", "image"),
    "openrailwaymap": ("{base}/standard/{z}/{x}/{y}.png", "image"),
}


def addresses(tiles: DataFrame, preset: str, base: str, product: str = "") -> DataFrame:
    """Tiles (``lat, lon`` in whole degrees, or ``x, y, z``) with the ``address`` of each in a source and its ``kind`` of file."""
    pattern, kind = PRESETS[preset]
    out = F.lit(pattern.replace("{base}", base).replace("{product}", product))
    parts = {c: F.col(c).cast("string") for c in "xyz"}
    if "{lat" in pattern:
        parts = dict(zip(("lat", "lon"), degree_name(F.col("lat"), F.col("lon")), strict=True)) | dict(zip(("lat5", "lon5"), degree_name(F.col("lat"), F.col("lon"), 5), strict=True))
    for k, c in parts.items():
        out = F.replace(out, F.lit("{" + k + "}"), c)
    return tiles.withColumns({"address": out, "kind": F.lit(kind)})


def height_preset(provider: str) -> str:
    names = {"GLO": "dem_glo", "SRTM": "dem_srtm", "ALOS": "dem_alos"}
    if provider not in names:
        raise ValueError(f"provider is one of {', '.join(names)}, not {provider}")
    return names[provider]


def degree_name(lat: Column, lon: Column, size: int = 1) -> tuple[Column, Column]:
    """Names like N05 and W010 of the cells of ``size`` degrees that whole degrees lie in."""
    down = lambda c: F.floor(c / size) * size
    a, b = down(lat).cast("int"), down(lon).cast("int")
    return F.concat(F.when(a < 0, "S").otherwise("N"), F.lpad(F.abs(a).cast("string"), 2, "0")), F.concat(F.when(b < 0, "W").otherwise("E"), F.lpad(F.abs(b).cast("string"), 3, "0"))


def degree_tiles(boxes: DataFrame, size: int = 1) -> DataFrame:
    """The tiles that boxes (minx, miny, maxx, maxy) need: floor to ceil - 1 of each axis, with their names."""
    spread = lambda a, b: F.explode(F.sequence(F.floor(a).cast("int"), F.greatest(F.floor(a), F.ceil(b) - 1).cast("int")))
    out = boxes.withColumn("lat", spread("miny", "maxy")).withColumn("lon", spread("minx", "maxx"))
    lat, lon = degree_name(F.col("lat"), F.col("lon"), size)
    return out.select("lat", "lon", F.concat(lat, lon).alias("tile")).distinct()


def web_tiles(boxes: DataFrame, zoom: int) -> DataFrame:
    """Web Mercator tiles of boxes at a zoom, with their western and northern edges."""
    out = boxes.withColumn("x", F.explode(F.sequence(C.tile_x("minx", zoom), C.tile_x("maxx", zoom)))).withColumn("y", F.explode(F.sequence(C.tile_y("maxy", zoom), C.tile_y("miny", zoom))))
    return out.select("x", "y", F.lit(zoom).alias("z"), C.tile_lon("x", zoom).alias("west"), C.tile_lat("y", zoom).alias("north")).distinct()


def mosaic(tiles: DataFrame, value: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Tiles' cells (lat, lon, value) as one grid: one row for each coordinate, within a box."""
    out = tiles.groupBy("lat", "lon").agg(F.first(value, ignorenulls=True).alias(value))
    return out if box is None else out.filter(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))


def with_alpha(image: DataFrame) -> DataFrame:
    """An alpha band of 255 where any of r, g, b isn't 0."""
    return image.withColumn("a", F.when(F.col("r") + F.col("g") + F.col("b") != 0, 255).otherwise(0))


def earth_box(lat: float, metres: float) -> tuple[float, float]:
    """Degrees of latitude and longitude that a distance spans."""
    return metres / 111320.0, metres / (111320.0 * math.cos(math.radians(lat)))
