"""Registered raster queries over a grid that grows with the tables: a cell for each order, lines of 64 cells, several tiles.

A cell's value is the quantity of its returned items; cells without any are missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringework.operators import raster
from fringework.operators.raster import Grid
from fringework.plans.queries import query, r, rounded
from fringework.shared import table

WIDTH, TILE, LEAST = 64, 32, 70
CELLS = f"""WITH RECURSIVE cells AS (SELECT l_orderkey // {WIDTH} AS y, l_orderkey % {WIDTH} AS x, CAST(sum(CASE WHEN l_returnflag = 'R' THEN floor(l_quantity * 64) END) AS DOUBLE) / 64 AS v FROM lineitem GROUP BY ALL),
size AS (SELECT max(y) + 1 AS ny FROM cells), cross_ AS (SELECT * FROM (VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) t(a, b)),
mask AS (SELECT y, x, CASE WHEN v >= {LEAST} THEN 1 ELSE 0 END AS m FROM cells)"""


def cells(spark, sf) -> tuple[DataFrame, Grid]:
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg((F.sum(F.when(F.col("l_returnflag") == "R", F.floor(F.col("l_quantity") * 64))).cast("double") / 64).alias("v"))
    out = rows.select(F.floor(F.col("l_orderkey") / WIDTH).cast("double").alias("y"), (F.col("l_orderkey") % WIDTH).cast("double").alias("x"), "v")
    last = table(spark, sf, "lineitem").agg(F.max("l_orderkey")).first()[0]
    return out, Grid(0.0, 1.0, (last or 0) // WIDTH + 1, 0.0, 1.0, WIDTH)


def _morph(source: str, out: str, erode: bool) -> str:
    test = "sum(b.m) = 5" if erode else "max(b.m) = 1"
    return f"{out} AS (SELECT c.y, c.x, CASE WHEN {test} THEN 1 ELSE 0 END AS m FROM {source} c, cross_ o, {source} b WHERE b.y = c.y + o.a AND b.x = c.x + o.b GROUP BY c.y, c.x)"


@query(f"""{CELLS}, g AS (SELECT yy.y, xx.x, a.a, b.b, CASE WHEN yy.y + a.a < 0 THEN -(yy.y + a.a) - 1 WHEN yy.y + a.a >= ny THEN 2 * ny - 1 - (yy.y + a.a) ELSE yy.y + a.a END AS sy, CASE WHEN xx.x + b.b < 0 THEN -(xx.x + b.b) - 1 WHEN xx.x + b.b >= {WIDTH} THEN {2 * WIDTH - 1} - (xx.x + b.b) ELSE xx.x + b.b END AS sx
  FROM size, (SELECT DISTINCT y FROM cells UNION SELECT unnest(generate_series(0, (SELECT ny - 1 FROM size)))) yy(y), range({WIDTH}) xx(x), range(-2, 3) a(a), range(-2, 3) b(b)),
k AS (SELECT g.y, g.x, exp(-0.5e0 * (a * a + b * b)) AS k, c.v FROM g JOIN cells c ON c.y = g.sy AND c.x = g.sx WHERE c.v IS NOT NULL)
SELECT CAST(y AS DOUBLE) AS y, CAST(x AS DOUBLE) AS x, {r('sum(k * v) / sum(k)', 4)} AS v FROM k GROUP BY y, x""", base=False)
def wide_gaussian(spark, sf):
    d, g = cells(spark, sf)
    return rounded(raster.gaussian(d, ["v"], (1.0, 1.0), truncate=2.0, grid=g, tile=TILE).filter("v IS NOT NULL"), "v", digits=4)


@query(f"{CELLS}, {_morph('mask', 'e', True)}, {_morph('e', 'o', False)} SELECT CAST(y AS DOUBLE) AS y, CAST(x AS DOUBLE) AS x, m = 1 AS mask FROM o", base=False)
def wide_opening(spark, sf):
    d, g = cells(spark, sf)
    return raster.opening(d.select("y", "x", F.coalesce(F.col("v") >= LEAST, F.lit(False)).alias("mask")), grid=g)


@query(f"""{CELLS}, s AS (SELECT y, x, y * {WIDTH} + x AS id FROM mask WHERE m = 1),
reach AS (SELECT id, y, x FROM s UNION SELECT t.id, b.y, b.x FROM reach t, cross_ o, s b WHERE b.y = t.y + o.a AND b.x = t.x + o.b)
SELECT CAST(y AS DOUBLE) AS y, CAST(x AS DOUBLE) AS x, CAST(min(id) AS BIGINT) AS label FROM reach GROUP BY y, x""", base=False)
def wide_components(spark, sf):
    d, g = cells(spark, sf)
    return raster.label(d.select("y", "x", (F.col("v") >= LEAST).alias("mask")), grid=g)


@query(f"""{CELLS}, o AS (SELECT a, b FROM range(-2, 3) a(a), range(-2, 3) b(b) WHERE a * a + b * b < 9),
n AS (SELECT h.y, h.x, b.v, row_number() OVER (PARTITION BY h.y, h.x ORDER BY o.a * o.a + o.b * o.b, b.y, b.x) AS k FROM cells h, o, cells b WHERE h.v IS NULL AND b.y = h.y + o.a AND b.x = h.x + o.b AND b.v IS NOT NULL)
SELECT CAST(c.y AS DOUBLE) AS y, CAST(c.x AS DOUBLE) AS x, coalesce(c.v, n.v) AS v FROM cells c LEFT JOIN n ON n.y = c.y AND n.x = c.x AND n.k = 1""", base=False)
def wide_fill(spark, sf):
    d, g = cells(spark, sf)
    return raster.fill_nearest(d, "v", 3, grid=g)


@query(f"""{CELLS} SELECT CAST((y // 8) * 8 + 3.5e0 AS DOUBLE) AS y, CAST((x // 8) * 8 + 3.5e0 AS DOUBLE) AS x, {r('avg(v)')} AS v FROM cells, size WHERE y < ny // 8 * 8 GROUP BY ALL""", base=False)
def wide_blocks(spark, sf):
    d, g = cells(spark, sf)
    return rounded(raster.coarsen(d, (8, 8), ["v"], grid=g), "v")
