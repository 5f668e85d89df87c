"""Exports of geocoded grids: GeoJSON and CSV lines, rasters and structured grids for other tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringework.functions.columns import finite
from fringework.operators.raster import Grid
from fringework.sources import formats


def csv_rows(data: DataFrame, value: str, key: str | None = None, digits: int = 2, coord_digits: int = 6) -> DataFrame:
    """``[key,] lon, lat, value`` rounded, without missing or infinite values."""
    return data.filter(finite(value)).select(*([key] if key else []), F.round("lon", coord_digits).alias("lon"), F.round("lat", coord_digits).alias("lat"), F.round(value, digits).alias(value))


def write_csv(data: DataFrame, path: str, value: str, key: str | None = None, delimiter: str = ",", digits: int = 2, coord_digits: int = 6) -> None:
    csv_rows(data, value, key, digits, coord_digits).write.mode("overwrite").option("header", "true").option("sep", delimiter).csv(path)


def pivoted(data: DataFrame, value: str, key: str, keys: list[str] | None = None, digits: int = 2, coord_digits: int = 6) -> DataFrame:
    """One row for each point and a column for each slice. ``keys`` names the slices and spares a pass over the data."""
    rows = csv_rows(data.withColumn(key, F.col(key).cast("string")), value, key, digits, coord_digits)
    return rows.groupBy("lon", "lat").pivot(key, keys).agg(F.first(value))


def geojson_lines(data: DataFrame, value: str, key: str | None = None, pivotal: bool = True, keys: list[str] | None = None, digits: int = 2, coord_digits: int = 6) -> DataFrame:
    """A point feature a row; the slices are properties of one feature if ``pivotal``."""
    rows = pivoted(data, value, key, keys, digits, coord_digits) if key and pivotal else csv_rows(data.withColumn(key, F.col(key).cast("string")) if key else data, value, key, digits, coord_digits)
    props = [c for c in rows.columns if c not in ("lon", "lat")]
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*(F.col(f"`{c}`").alias(c) for c in props)).alias("properties"), point.alias("geometry"))
    return rows.select(F.to_json(feature).alias("value"))


def write_geojson(data: DataFrame, path: str, value: str, **options) -> None:
    """Newline-delimited features, a file for each task."""
    geojson_lines(data, value, **options).write.mode("overwrite").text(path)


def reference_system(columns: list[str]) -> int:
    """EPSG code: geographic grids 4326, radar grids a plane (3857)."""
    if is_geo(columns):
        return 4326
    if is_radar(columns):
        return 3857
    raise ValueError("a grid has y and x, or lat and lon")


def is_radar(columns: list[str]) -> bool:
    return {"y", "x"} <= set(columns)


def is_geo(columns: list[str]) -> bool:
    return {"lat", "lon"} <= set(columns)


def raster_table(data: DataFrame, path: str, value: str, key: str | None = None) -> None:
    """A grid as Parquet by slices, with rows in scan order: what GeoTIFF or NetCDF writers on the reading side take in order."""
    rows = data.sort(*( [key] if key else []), F.desc("lat"), "lon")
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(key) if key else writer).parquet(path)


def on_topography(data: DataFrame, topo: DataFrame, image: DataFrame | None = None, values: list[str] | None = None, mask_finite: bool = True, sea_level: bool = False) -> DataFrame:
    """Points of a structured grid: ``lat, lon, z`` with the values and, if given, the image's bands; ``z`` only where the data
    are finite if ``mask_finite``, not below 0 if ``sea_level``."""
    z = F.greatest("z", F.lit(0.0)) if sea_level else F.col("z")
    out = data.join(topo.select("lat", "lon", F.col("ele").alias("z")), ["lat", "lon"], "left")
    if image is not None:
        out = out.join(image, ["lat", "lon"], "left")
    there: Column = F.lit(True)
    if mask_finite and values:
        for v in values:
            there = there & finite(v)
    return out.withColumn("z", F.when(there, z))


def vtk_lines(data: DataFrame, values: list[str], grid: Grid, key: str | None = None, z: str | None = None, title: str = "grid", missing: str = "nan", y: str = "lat", x: str = "lon") -> DataFrame:
    """Lines of a structured grid as legacy VTK text: ``[key,] part, row, line``, whose order (part, row) is that of the file.

    Part 0 is the head, part 1 the points of each grid line (x y z; 0 without ``z``), then two parts for each value: its head
    and its numbers by grid line. A grid line is one row, so a slice of any size is many rows; cells that aren't there are
    ``missing`` (their z is 0).
    """
    keys = [key] if key else []
    text = lambda c: F.coalesce(F.when(~F.isnan(c.cast("double")), c.cast("double")).cast("string"), F.lit(missing))
    cells = data.select(*keys, grid.iy(F.col(y)).alias("row"), grid.ix(F.col(x)).alias("col"), *(F.col(v) for v in values), *([F.col(z).alias("_z")] if z else []))
    cells = cells.filter(F.col("row").between(0, grid.ny - 1) & F.col("col").between(0, grid.nx - 1))
    fields = [*(F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)), (F.col("_z") if z else F.lit(0.0)).cast("double").alias("z")]
    found = cells.groupBy(*keys, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.struct(*fields).alias("f")))).alias("m"))
    spark = data.sparkSession
    slices = data.select(*keys).distinct() if keys else spark.range(1).select()
    rows = slices.join(spark.range(grid.ny).select(F.col("id").cast("int").alias("row")), F.lit(True)).join(found, [*keys, "row"], "left")
    cols = F.sequence(F.lit(0), F.lit(grid.nx - 1))
    lat = (F.lit(float(grid.y0)) + F.col("row") * float(grid.dy)).cast("string")

    def at(i: Column, name: str) -> Column:
        return F.try_element_at(F.col("m"), i)[name]

    points = F.array_join(F.transform(cols, lambda i: F.concat_ws(" ", (F.lit(float(grid.x0)) + i * float(grid.dx)).cast("string"), lat, F.coalesce(at(i, "z"), F.lit(0.0)).cast("string"))), " ")
    parts = [rows.select(*keys, F.lit(1).alias("part"), "row", points.alias("line"))]

    def numbers(name: str) -> Column:
        return F.array_join(F.transform(cols, lambda i: text(at(i, name))), " ")

    parts += [rows.select(*keys, F.lit(3 + 2 * k).alias("part"), "row", numbers(f"v{k}").alias("line")) for k in range(len(values))]
    n = grid.ny * grid.nx
    heads = {0: ["# vtk DataFile Version 3.0", title, "ASCII", "DATASET STRUCTURED_GRID", f"DIMENSIONS {grid.nx} {grid.ny} 1", f"POINTS {n} double"]}
    heads |= {2 + 2 * k: [*([f"POINT_DATA {n}"] if not k else []), f"SCALARS {v} double 1", "LOOKUP_TABLE default"] for k, v in enumerate(values)}
    lines = spark.createDataFrame([(p, i, t) for p, head in heads.items() for i, t in enumerate(head)], "part int, row int, line string")
    out = slices.join(F.broadcast(lines), F.lit(True)).select(*keys, "part", "row", "line")
    for p in parts:
        out = out.unionByName(p)
    return out


def write_vtk(data: DataFrame, path: str, values: list[str], grid: Grid, **options) -> None:
    """One legacy VTK file from ``vtk_lines``; the driver passes the lines on in order and holds one at a time."""
    lines = vtk_lines(data, values, grid, **options).orderBy("part", "row")
    formats.write_bytes(data.sparkSession, path, (r.line.encode() + b"\n" for r in lines.toLocalIterator()))


def ascii_grid(data: DataFrame, value: str, fill: float = -9999.0) -> DataFrame:
    """Lines of a text raster from north to south: ``lat, line``; a row of the grid is one line."""
    cell = F.struct("lon", F.coalesce(F.col(value), F.lit(fill)).alias("v"))
    return data.groupBy("lat").agg(F.sort_array(F.collect_list(cell)).alias("c")).select("lat", F.array_join(F.transform("c", lambda x: x["v"].cast("string")), " ").alias("line")).orderBy(F.desc("lat"))
