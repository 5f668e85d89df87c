"""Registered queries of sources, stores, sessions, parameters and formats over the driver's tables, with their SQL.

Files that a query reads are made from the tables first, in the folder that driver and executors share.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringework.functions import geometry
from fringework.functions.columns import SPEED_OF_LIGHT
from fringework.operators import align, export, geocode, params, raster, regression, report, stats, stl, unwrap2d
from fringework.operators import pairs as P
from fringework.operators.raster import Grid
from fringework.plans import samples as S
from fringework.plans.queries import DAY, DEM, GRID, IN_SCENE, NAME, PI, _dem, _orbit, _radar, _scene, query, r, rounded
from fringework.session import Fan, Session
from fringework.shared import new_path, table
from fringework.sources import catalog, formats, rasters
from fringework.sources.store import Store

C_LIGHT = f"{SPEED_OF_LIGHT!r}e0"

# ---- files of scenes


ANNOTATED = "WITH p AS (SELECT event_id, ts, event_id // 40 AS line, event_id % 40 AS pixel, value / 8 AS lat, value / 4 AS lon FROM events)"


@query(f"{ANNOTATED} SELECT CAST(line AS DOUBLE) AS line, CAST(pixel AS DOUBLE) AS pixel, {r('lat', 4)} AS latitude, {r('lon', 4)} AS longitude, {r('lon', 4)} AS point_lon FROM p", base=False)
def geolocation_grid(spark, sf):
    """Annotation files written and read back: elements by their tag, numbers as doubles, points."""
    e = table(spark, sf, "events")
    tag = lambda n, c: F.concat(F.lit(f"<{n}>"), c, F.lit(f"</{n}>"))
    point = F.concat(tag("azimuthTime", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), tag("line", F.floor(F.col("event_id") / 40).cast("string")), tag("pixel", (F.col("event_id") % 40).cast("string")), tag("latitude", (F.col("value") / 8).cast("string")), tag("longitude", (F.col("value") / 4).cast("string")))
    path = new_path(spark, "annotation")
    rows = e.select(F.date_format("ts", "'d'yyyyMMdd").alias("day"), F.lit(1).alias("nth"), tag("geolocationGridPoint", point).alias("value"))
    for nth, text in ((0, "<product><geolocationGrid>"), (2, "</geolocationGrid></product>")):
        rows = rows.unionByName(e.select(F.date_format("ts", "'d'yyyyMMdd").alias("day")).distinct().select("day", F.lit(nth).alias("nth"), F.lit(text).alias("value")))
    rows.repartition("day").sortWithinPartitions("day", "nth").select("day", "value").write.partitionBy("day").text(path)  # a file for each day
    out = catalog.geolocation(spark, path).select(F.col("line").cast("double").alias("line"), F.col("pixel").cast("double").alias("pixel"), "latitude", "longitude", F.col("point.lon").alias("point_lon"))
    return rounded(out, "latitude", "longitude", "point_lon", digits=4)


@query("""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events) SELECT strftime(date, '%Y-%m-%d') AS date, 'S1A' AS mission, CAST(1 AS INTEGER) AS subswath, 'VV' AS polarization,
  's1a-iw1-slc-vv-' || strftime(date, '%Y%m%d') || 't120000-' || strftime(date, '%Y%m%d') || 't120020-012345-0abcde-004' AS name,
  'S1A_OPER_AUX_' || CASE WHEN day(date) % 3 = 0 THEN 'RES' ELSE 'POE' END || 'ORB_OPOD_' || strftime(date + INTERVAL 20 DAY, '%Y%m%d') || 'T000000_V' || strftime(date - INTERVAL 1 DAY, '%Y%m%d') || 'T225942_' || strftime(date + INTERVAL 1 DAY, '%Y%m%d') || 'T005942' AS orbit FROM d""", base=False)
def catalog_scan(spark, sf):
    """A folder of measurements, annotations and orbit files scanned into a catalog."""
    folder = new_path(spark, "scenes")
    names = S.scenes(spark, sf).select(F.date_format("date", "yyyyMMdd").alias("d"), F.date_format(F.date_sub("date", 1), "yyyyMMdd").alias("a"), F.date_format(F.date_add("date", 1), "yyyyMMdd").alias("b"), F.date_format(F.date_add("date", 20), "yyyyMMdd").alias("made"), F.when(F.dayofmonth("date") % 3 == 0, "RES").otherwise("POE").alias("kind"))
    for x in names.collect():  # one for each scene
        base = f"s1a-iw1-slc-vv-{x.d}t120000-{x.d}t120020-012345-0abcde-004"
        for name in (f"{base}.tiff", f"{base}.xml", f"S1A_OPER_AUX_{x.kind}ORB_OPOD_{x.made}T000000_V{x.a}T225942_{x.b}T005942.EOF"):
            formats.write_bytes(spark, f"{folder}/{name}", [b"x"])
    base = lambda c: F.regexp_extract(c, r"([^/]*)\.[^./]*$", 1)
    return catalog.scan(spark, folder).select("date", "mission", "subswath", "polarization", base("datapath").alias("name"), base("orbitpath").alias("orbit"))


@query("""SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'burst' ELSE 'scene' END AS kind, count(*) AS n, min(o_orderkey) AS first FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY ALL""", base=False)
def requests_by_kind(spark, sf):
    """Requests that aren't there yet, burst requests apart from whole scenes."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("S1_"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, "-BURST").otherwise("")).alias("name"))
    bursts, scenes = catalog.split_requests(catalog.missing(o, o.filter("k % 7 = 0")))
    both = bursts.select(F.lit("burst").alias("kind"), "k").unionByName(scenes.select(F.lit("scene").alias("kind"), "k"))
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.min("k").alias("first"))


@query("WITH t AS (SELECT min(ts) + INTERVAL 10 HOUR AS t FROM events) SELECT event_id, CAST(user_id - 25 * 3 AS BIGINT) AS line FROM events, t WHERE abs(epoch_us(ts) - epoch_us(t)) <= 7200000000", base=False)
def burst_of_time(spark, sf):
    """Rows near a time, lines counted from a burst's start."""
    e = table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    middle = e.agg(F.min("t")).first()[0]
    near = catalog.near_time(e, F.lit(middle) + F.expr("interval 10 hours"), 7200, "t")
    return catalog.burst_lines(near.select("event_id", F.col("user_id").alias("line")), 25, 3).select("event_id", "line")


@query("""WITH b AS (SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS x, CAST(c_custkey % 60 AS DOUBLE) AS y FROM customer) SELECT c_custkey FROM b WHERE x + 2 >= 5 AND x <= 9 AND y + 1 >= 10 AND y <= 20""", base=False)
def reframe(spark, sf):
    """Bursts whose outline meets an area."""
    x, y = F.col("c_nationkey").cast("double"), (F.col("c_custkey") % 60).cast("double")
    corner = lambda dx, dy: F.struct((x + dx).alias("lon"), (y + dy).alias("lat"))
    b = table(spark, sf, "customer").select("c_custkey", F.array(corner(0, 0), corner(2, 0), corner(2, 1), corner(0, 1), corner(0, 0)).alias("ring"))
    return catalog.within(b, 5, 10, 9, 20).select("c_custkey")


# ---- tiles and raster files

TILES = "WITH b AS (SELECT DISTINCT c_nationkey * 7 - 80 AS lon, c_nationkey * 3 - 36 AS lat FROM customer)"
SIGNED = "CASE WHEN {0} < 0 THEN '{2}' ELSE '{1}' END || lpad(CAST(abs({0}) AS VARCHAR), {3}, '0')"
LAT, LON = SIGNED.format("lat", "N", "S", 2), SIGNED.format("lon", "E", "W", 3)
LAT5, LON5 = SIGNED.format("CAST(floor(lat / 5e0) * 5 AS INTEGER)", "N", "S", 2), SIGNED.format("CAST(floor(lon / 5e0) * 5 AS INTEGER)", "E", "W", 3)


@query(f"""{TILES}, t AS (SELECT {LAT} AS a, {LON} AS o, {LAT5} AS a5, {LON5} AS o5 FROM b),
w AS (SELECT DISTINCT CAST(floor((lon + 180) / 360e0 * 1024) AS INTEGER) AS x, CAST(floor((1 - asinh(tan(radians(lat + 0.1e0))) / {PI}) / 2 * 1024) AS INTEGER) AS y FROM b),
u AS (SELECT x, y, unnest(['maps', 'satellite', 'satellite_hybrid']) AS preset, unnest(['m', 's', 'y']) AS layer FROM w)
SELECT 'landmask' AS preset, 'at/landmask/1s/' || a || '/' || a || o || '.nc.zip' AS address, 'netcdf' AS kind FROM t
UNION ALL SELECT 'dem_glo', 'at/glo/GLO_30/' || a || '_00_' || o || '_00.tif', 'geotiff' FROM t UNION ALL SELECT 'dem_srtm', 'at/srtm/1s/' || a || '/' || a || o || '.hgt.gz', 'hgt' FROM t
UNION ALL SELECT 'dem_alos', 'at/alos/' || a5 || o5 || '/' || a || o || '.tif', 'geotiff' FROM t
UNION ALL SELECT preset, 'at/lyrs=' || layer || '&x=' || x || '&y=' || y || '&z=10', 'image' FROM u
UNION ALL SELECT 'openstreetmap', 'at/10/' || x || '/' || y || '.png', 'image' FROM w UNION ALL SELECT 'openrailwaymap', 'at/standard/10/' || x || '/' || y || '.png', 'image' FROM w""", base=False)
def tile_addresses(spark, sf):
    """Where the tiles of all sources lie: height models, land masks and map layers."""
    lon, lat = (F.col("c_nationkey") * 7 - 80).cast("double"), (F.col("c_nationkey") * 3 - 36).cast("double")
    c = table(spark, sf, "customer")
    degree = rasters.degree_tiles(c.select(lon.alias("minx"), lat.alias("miny"), lon.alias("maxx"), lat.alias("maxy")).distinct())
    web = rasters.web_tiles(c.select(lon.alias("minx"), (lat + 0.1).alias("miny"), lon.alias("maxx"), (lat + 0.1).alias("maxy")).distinct(), 10)
    out = None
    for preset, (pattern, _) in rasters.PRESETS.items():
        one = rasters.addresses(degree if "{lat" in pattern else web, preset, "at", "GLO_30").select(F.lit(preset).alias("preset"), "address", "kind")
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH n AS (SELECT n_nationkey AS k, n_nationkey % 20 - 9 AS south, n_nationkey * 5 - 60 AS west FROM nation), c AS (SELECT k, south, west, i, j, k * 100 + i * 10 + j AS v FROM n, range(5) a(i), range(5) b(j))
SELECT CAST(south + 1 - i / 4e0 AS DOUBLE) AS lat, CAST(west + j / 4e0 AS DOUBLE) AS lon, CASE WHEN v % 7 <> 0 THEN CAST(v AS DOUBLE) END AS ele FROM c""", base=False)
def height_tiles(spark, sf):
    """Heights decoded from tiles of big-endian numbers, from files of one degree named after their corner."""
    k = F.col("n_nationkey")
    lat, lon = rasters.degree_name(k % 20 - 9, k * 5 - 60)
    cell = lambda n: F.lpad(F.hex(F.when((k * 100 + F.floor(n / 5) * 10 + n % 5) % 7 == 0, F.lit(0x8000)).otherwise(k * 100 + F.floor(n / 5) * 10 + n % 5).cast("long")), 4, "0")
    content = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(24)), cell), ""))
    found = table(spark, sf, "nation").select(F.concat(F.lit("/tiles/"), lat, lon, F.lit(".hgt")).alias("path"), content.alias("content"))
    return formats.height_tiles(found).select("lat", "lon", "ele")


def _geo(spark, sf) -> DataFrame:
    return S.total(spark, sf).select((F.col("y") / 4 + 10).alias("lat"), (F.col("x") / 8 - 3).alias("lon"), "v")


GEO_GRID = Grid(10.0, 0.25, 12, -3.0, 0.125, 10)


@query("SELECT y / 4 + 10 AS lat, x / 8 - 3 AS lon, CASE WHEN v >= 40 THEN v END AS v FROM total")
def geotiff(spark, sf):
    """A GeoTIFF of several tiles, written and read back."""
    path = new_path(spark, "geotiff")
    formats.write_geotiff(_geo(spark, sf).withColumn("v", F.when(F.col("v") >= 40, F.col("v"))), path, "v", GEO_GRID, tile=16)
    return formats.read_geotiff(formats.files(spark, path)).select("lat", "lon", "v")


@query("SELECT y / 4 + 10 AS lat, x / 8 - 3 AS lon, CASE WHEN v >= 40 THEN v END AS v FROM total")
def netcdf(spark, sf):
    """A classic NetCDF file, written and read back."""
    path = new_path(spark, "netcdf")
    formats.write_netcdf(_geo(spark, sf).withColumn("v", F.when(F.col("v") >= 40, F.col("v"))), path, "v", GEO_GRID)
    return formats.read_netcdf(formats.files(spark, path)).select("lat", "lon", "v")


@query("""SELECT CAST(0 AS INTEGER) AS part, CAST(i AS INTEGER) AS row, line FROM (SELECT generate_subscripts(l, 1) - 1 AS i, unnest(l) AS line FROM (SELECT ['# vtk DataFile Version 3.0', 'grid', 'ASCII', 'DATASET STRUCTURED_GRID', 'DIMENSIONS 10 12 1', 'POINTS 120 double'] AS l))
UNION ALL SELECT 2, CAST(i AS INTEGER), line FROM (SELECT generate_subscripts(l, 1) - 1 AS i, unnest(l) AS line FROM (SELECT ['POINT_DATA 120', 'SCALARS v double 1', 'LOOKUP_TABLE default'] AS l))
UNION ALL SELECT 1, CAST(y AS INTEGER), string_agg((x / 8 - 3) || ' ' || (y / 4 + 10) || ' ' || (v / 64), ' ' ORDER BY x) FROM total GROUP BY y UNION ALL SELECT 3, CAST(y AS INTEGER), string_agg(CASE WHEN v >= 40 THEN CAST(v AS VARCHAR) ELSE 'nan' END, ' ' ORDER BY x) FROM total GROUP BY y""")
def vtk(spark, sf):
    """A structured grid on topography as VTK text."""
    g = _geo(spark, sf)
    on = export.on_topography(g.withColumn("v", F.when(F.col("v") >= 40, F.col("v"))), g.select("lat", "lon", (F.col("v") / 64).alias("ele")))
    return export.vtk_lines(on, ["v"], GEO_GRID, z="z")


@query("SELECT y + 0.5 AS y, x + 0.5 AS x, CASE WHEN re <> 0 OR im <> 0 THEN CAST(re AS FLOAT) END AS re, CASE WHEN re <> 0 OR im <> 0 THEN CAST(im AS FLOAT) END AS im FROM (SELECT y, x, CAST(v * 64 AS BIGINT) % 3000 AS re, (CAST(v * 64 AS BIGINT) // 3000) % 1000 - 3 AS im FROM total)")
def raw_samples(spark, sf):
    """Interleaved samples of a raw file, read line by line."""
    whole = (F.col("v") * 64).cast("long")
    rows = S.total(spark, sf).select("y", "x", (whole % 3000).cast("int").alias("re"), (F.floor(whole / 3000) % 1000 - 3).cast("int").alias("im"))
    lines = rows.groupBy("y").agg(F.sort_array(F.collect_list(F.struct("x", "re", "im"))).alias("s")).orderBy("y")
    path = new_path(spark, "samples")
    formats.write_bytes(spark, path, (struct.pack(f"<{2 * len(x.s)}h", *(n for c in x.s for n in (c.re, c.im))) for x in lines.toLocalIterator()))
    return rasters.read_samples(spark, path, 10, scale=1.0)


@query("SELECT CAST(dayofyear(ts) * 86400 + event_id AS DOUBLE) AS clock, value AS px, value * 2 AS py, CAST(user_id AS DOUBLE) AS vz FROM events", base=False)
def orbit_vectors(spark, sf):
    """State vectors of orbit files."""
    e = table(spark, sf, "events")
    words = [F.lit("2024"), F.dayofyear("ts"), F.col("event_id").cast("double"), F.col("value"), F.col("value") * 2, F.lit(0), F.lit(1), F.lit(2), F.col("user_id")]
    path = new_path(spark, "orbit")
    head = spark.createDataFrame([("2 2024 1 0 10",)], "value string")
    head.unionByName(e.select(F.concat_ws(" ", *(w.cast("string") for w in words)).alias("value"))).write.text(path)
    return rasters.read_orbit(spark, path).select("clock", "px", "py", "vz")


@query("SELECT date, CASE WHEN x < 5 THEN y + 2 ELSE y END AS y, x, re, im FROM slc WHERE (re <> 0 OR im <> 0) AND x BETWEEN 1 AND 8 AND CASE WHEN x < 5 THEN y + 2 ELSE y END BETWEEN 1 AND 12")
def samples_stitched(spark, sf):
    """Subswaths side by side in one grid by their offsets, within a box."""
    s = S.slc(spark, sf)
    two = F.col("x") >= 5
    parts = s.select("date", F.when(two, 2).otherwise(1).alias("subswath"), "y", F.when(two, F.col("x") - 5).otherwise(F.col("x")).alias("x"), "re", "im")
    offsets = S.scenes(spark, sf).select("date", F.explode(F.array(F.lit(1), F.lit(2))).alias("subswath")).select("date", "subswath", ((2 - F.col("subswath")) * 2).alias("bottom"), ((F.col("subswath") - 1) * 5).alias("left"))
    return rasters.stitched(parts, offsets, (1, 1, 8, 12)).filter("re IS NOT NULL")


# ---- height models and masks

@query(f"""SELECT round(y / 7, 8) + 0e0 AS lat, round(x / 7, 8) + 0e0 AS lon, CASE WHEN v >= 40 THEN {r('v / 64 + (10 + 2 * y / 7 + 3 * x / 7)', 4)} END AS ele FROM total WHERE round(x / 7, 8) BETWEEN 0.2e0 - 0.02e0 AND 1.1e0 + 0.02e0 AND round(y / 7, 8) BETWEEN 0.3e0 - 0.02e0 AND 1.2e0 + 0.02e0""")
def height_model(spark, sf):
    """A height model cut to a box with a buffer, over the ellipsoid by a geoid of coarser cells."""
    m = S.total(spark, sf).select((F.col("y") / 7).alias("lat"), (F.col("x") / 7).alias("lon"), F.when(F.col("v") >= 40, F.col("v") / 64).otherwise(float("nan")).alias("ele"))
    store = Store(spark, new_path(spark, "store"))
    store.save_cube(m, "model")
    store.register("dem", store.path("model"))
    clean = rasters.clean_model(store.registered("dem"), box=(0.2, 0.3, 1.1, 1.2))
    geoid = spark.range(56).select((F.floor(F.col("id") / 7) * 0.25).alias("lat"), ((F.col("id") % 7) * 0.25).alias("lon")).withColumn("geoid", 10 + 2 * F.col("lat") + 3 * F.col("lon"))
    return rounded(rasters.over_ellipsoid(clean, geoid, Grid(0.0, 0.25, 8, 0.0, 0.25, 7)), "ele", digits=4)


@query("SELECT y AS lat, x AS lon, CASE WHEN v >= 40 THEN 1e0 ELSE 0e0 END AS landmask FROM total WHERE y < 9")
def land_mask(spark, sf):
    """A land mask at the cells of a height model, missing cells being water."""
    t = S.total(spark, sf)
    mask = rasters.land_mask(t.select(F.col("y").alias("lat"), F.col("x").alias("lon"), F.when(F.col("v") >= 40, 1.0).otherwise(float("nan")).alias("landmask")))
    model = t.filter("y < 9").select((F.col("y") + 0.2).alias("lat"), (F.col("x") - 0.3).alias("lon"))
    out = rasters.mask_on(mask, GRID, model)
    return out.select(F.round("lat").alias("lat"), F.round("lon").alias("lon"), "landmask")


# ---- stores and sessions


@query("SELECT pair, y, x, CASE WHEN day(rep) % 5 = 0 THEN 2e0 ELSE 1e0 END AS version FROM data WHERE day(ref) % 2 = 1")
def store_stack(spark, sf):
    """A stack saved by slices, some of which a later save replaces, and opened by keys; what is missing is found."""
    store = Store(spark, new_path(spark, "store"))
    d = S.pair_data(spark, sf)
    store.save_stack(d.select("pair", "y", "x", F.lit(1.0).alias("version")), "stack")
    store.save_stack(d.filter(F.dayofmonth("rep") % 5 == 0).select("pair", "y", "x", F.lit(2.0).alias("version")), "stack")
    pairs = S.pairs(spark, sf).filter(F.dayofmonth("ref") % 2 == 1)
    assert store.missing_slices(pairs.select("pair"), "stack").isEmpty() or not d.count()
    return store.open_stack("stack").join(F.broadcast(pairs.select("pair")), "pair", "left_semi").select("pair", "y", "x", "version")


CUBES = ("trans", "trans_inv", "look", "tidal", "ps")


@query("SELECT unnest(['look', 'tidal', 'trans', 'trans_inv']) AS name, y, x, v FROM total")
def store_cubes(spark, sf):
    """Cubes saved under their names, one deleted, the rest listed and opened."""
    store = Store(spark, new_path(spark, "store"))
    for name in CUBES:
        store.sync_cube(S.total(spark, sf), name)
    store.delete_cube("ps")
    out = None
    for name in store.names("*"):
        one = store.open_cube(name).select(F.lit(name).alias("name"), "y", "x", "v")
        out = one if out is None else out.unionByName(one)
    return out


def _session(spark, sf) -> Session:
    out = Session(spark, new_path(spark, "session"))
    s = S.scenes(spark, sf)
    both = s.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("subswath"))
    out.set_scenes(both.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "subswath", "bperp", F.concat(F.lit("orbit"), F.dayofmonth("date").cast("string")).alias("orbitpath")))
    return out


@query("""SELECT strftime(date, '%Y-%m-%d') AS date, CAST(s.s AS INTEGER) AS subswath, bperp, date = (SELECT min(date) + INTERVAL 3 DAY FROM scenes) AS reference, strftime(date, '%Y-%m-%d') || '_F' || s.s AS prefix FROM scenes, range(1, 3) s(s)""")
def session_state(spark, sf):
    """A session's catalog and reference date, dumped, backed up to another folder and restored from there."""
    one = _session(spark, sf)
    first = one.scenes.agg(F.min("date")).first()[0]
    one.set_reference(str(spark.sql(f"SELECT date_add('{first}', 3)").first()[0]))
    copy = new_path(spark, "backup")
    one.backup(copy)
    back = Session.restore(spark, copy)
    rows = back.get_reference().select("*", F.lit(True).alias("reference")).unionByName(back.get_repeat().select("*", F.lit(False).alias("reference")))
    return rows.select("date", "subswath", "bperp", "reference", catalog.prefix(F.col("date"), F.col("subswath")).alias("prefix"))


@query(f"SELECT CAST(s.s AS INTEGER) AS session, CAST(s.s AS INTEGER) AS subswath, {NAME} AS pair FROM pairs, range(1, 3) s(s)")
def fan_of_sessions(spark, sf):
    """Two sessions that take the same calls, each with a value of its own."""
    one = _session(spark, sf)
    with Fan(one, one) as fan:
        fan.set_context(subswath=[1, 2])
        own = fan.run_method("get_subswath")
    both = Fan(one, one)
    found = both.run_callable(lambda s: P.make_pairs(s.scenes.filter("subswath = 1").select(F.col("date").cast("date").alias("date"), "bperp"), S.DAYS, S.METERS))
    out = None
    for i, (pairs, subswath) in enumerate(zip(found, own, strict=True), 1):
        rows = pairs.select(F.lit(i).alias("session"), F.lit(subswath).alias("subswath"), "pair")
        out = rows if out is None else out.unionByName(rows)
    return out


# ---- parameters


def _numbers(spark, sf) -> DataFrame:
    k = F.col("n_nationkey")
    values = {"PRF": 500 + k, "clock_start": k + 0.5, "clock_stop": k + 0.75, "SC_clock_start": k + 100.5, "SC_clock_stop": k + 100.75, "near_range": 800000 + k * 100, "rng_samp_rate": F.lit(64000000.0), "num_rng_bins": 1000 + k, "num_lines": 2000 + k, "num_valid_az": 1500 + k, "num_patches": F.lit(1), "ashift": k, "rshift": -k, "sub_int_a": F.lit(0.25), "sub_int_r": F.lit(0.5), "SLC_file": F.lit("a.slc")}
    return table(spark, sf, "nation").select(k.alias("k"), F.create_map(*(x for n, v in values.items() for x in (F.lit(n), v.cast("string")))).alias("params"))


@query("""WITH a AS (SELECT 'name' || (c_custkey % 50) AS name, arg_max(c_custkey % 7, c_custkey) AS v FROM customer GROUP BY ALL) SELECT name, CAST(v AS VARCHAR) AS value FROM a""", base=False)
def parameter_files(spark, sf):
    """A parameter file written as text and read back."""
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("name"), (F.col("c_custkey") % 50).cast("string")).alias("name"), (F.col("c_custkey") % 7).cast("string").alias("value"))
    last = params.latest(c, "c_custkey")
    path = new_path(spark, "params")
    params.write(last.agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("params")), path)
    return params.explode(params.read(spark, path)).select("name", "value")


@query("""SELECT CAST(n_nationkey AS INTEGER) AS k, CAST(2000 + n_nationkey AS BIGINT) AS num_lines, CAST(700 AS DOUBLE) AS prf, round(n_nationkey + 0.5e0 + 35 / (700e0) / 86400e0, 9) + 0e0 AS clock_start, CAST(803e0 + n_nationkey AS DOUBLE) AS shifted, CAST(2 AS INTEGER) AS chosen, 'a.slc' AS file FROM nation""", base=False)
def parameter_edits(spark, sf):
    """Values set, chosen, read as numbers, shifted, and clocks moved by lines."""
    rows = _numbers(spark, sf).withColumn("p", params.with_values(F.col("params"), PRF=700, earth_radius=6371000))
    p = F.col("p")
    return rows.select(
        "k",
        params.number(p, "num_lines").alias("num_lines"),
        params.number(p, "PRF").alias("prf"),
        F.round(params.number(params.shift_time(p, 35), "clock_start"), 9).alias("clock_start"),
        (params.number(params.shifted(params.select(p, "num_valid_az", "SLC_file"), 3), "num_valid_az").cast("double") - 700).alias("shifted"),
        F.size(params.select(p, "PRF", "SLC_file")).alias("chosen"),
        F.try_element_at(params.shifted(p, 1), F.lit("SLC_file")).alias("file"),
    )


@query(f"""SELECT CAST(n_nationkey AS INTEGER) AS k, round(800000 + n_nationkey * 100 + (-1 - n_nationkey + 0.5e0) * ({C_LIGHT} / 64000000 / 2), 4) + 0e0 AS near_range,
  round(n_nationkey + 100.5e0 + (n_nationkey + 0.25e0) / (500 + n_nationkey) / 86400, 9) + 0e0 AS start, round(n_nationkey + 100.5e0 + (n_nationkey + 0.25e0) / (500 + n_nationkey) / 86400 + (1500 + n_nationkey) / (500e0 + n_nationkey) / 86400, 9) + 0e0 AS stop FROM nation""", base=False)
def aligned_parameters(spark, sf):
    """Near range and clocks with the shifts of an alignment applied."""
    p = params.fix_aligned(F.col("params"))
    value = lambda n, d: F.round(params.number(p, n), d)
    return _numbers(spark, sf).select("k", value("near_range", 4).alias("near_range"), value("SC_clock_start", 9).alias("start"), value("SC_clock_stop", 9).alias("stop"))


STEP = f"({C_LIGHT} / 64000000 / 2)"


@query(f"""WITH t AS (SELECT n_regionkey AS d, n_nationkey AS k, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS s FROM nation),
q AS (SELECT d, k, s, 100 + s * 7 / 500e0 / 86400 * (s % 2) AS clock, 800000 + s * 900 * {STEP} AS near, 1000 + k AS bins, 1500 + k AS valid FROM t),
h AS (SELECT *, CAST(round((clock - first_value(clock) OVER w) * 86400 * 500) AS BIGINT) AS head, lag(bins) OVER w - CAST(round((near - lag(near) OVER w) / {STEP}) AS BIGINT) AS overlap FROM q WINDOW w AS (PARTITION BY d ORDER BY s)),
m AS (SELECT *, min(head) OVER (PARTITION BY d) AS minh, bins - coalesce(overlap, -1) - 1 AS wide FROM h)
SELECT CAST(d AS VARCHAR) AS date, CAST(s AS INTEGER) AS subswath, CAST(head - minh AS BIGINT) AS bottom, CAST(overlap AS BIGINT) AS overlap, CAST(sum(wide) OVER (PARTITION BY d ORDER BY s) - wide AS BIGINT) AS "left", CAST(max(valid + head - minh) OVER (PARTITION BY d) AS BIGINT) AS maxy, CAST(sum(wide) OVER (PARTITION BY d) AS BIGINT) AS maxx, CAST(minh AS BIGINT) AS minh FROM m""", base=False)
def stitching_offsets(spark, sf):
    """Where the subswaths of each date lie in the merged grid."""
    from pyspark.sql import Window

    s, k = F.col("s"), F.col("n_nationkey")
    rows = table(spark, sf, "nation").withColumn("s", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")))
    step = SPEED_OF_LIGHT / 64000000 / 2
    values = {"PRF": F.lit(500.0), "clock_start": 100 + s * 7 / 500.0 / 86400 * (s % 2), "near_range": 800000 + s * 900 * step, "rng_samp_rate": F.lit(64000000.0), "num_rng_bins": 1000 + k, "num_valid_az": 1500 + k}
    out = params.stitching(rows.select(F.col("n_regionkey").cast("string").alias("date"), s.alias("subswath"), F.create_map(*(x for n, v in values.items() for x in (F.lit(n), v.cast("string")))).alias("params")))
    return out.select("date", "subswath", "bottom", F.col("overlap").cast("long").alias("overlap"), "left", "maxy", "maxx", "minh")


@query("""SELECT CAST(n_nationkey AS INTEGER) AS k, CAST(3000 AS BIGINT) AS num_lines, CAST(2500 AS BIGINT) AS bins, round(n_nationkey + 0.5e0 - 40 / (500e0 + n_nationkey) / 86400, 9) + 0e0 AS clock_start, round(n_nationkey + 0.5e0 - 40 / (500e0 + n_nationkey) / 86400 + 3000 / (500e0 + n_nationkey) / 86400, 9) + 0e0 AS clock_stop FROM nation""", base=False)
def merged_parameters(spark, sf):
    """Extents of a merged scene, and its clocks."""
    p = params.fix_merged(F.col("params"), F.lit(3000), F.lit(2500), F.lit(-40))
    value = lambda n: F.round(params.number(p, n), 9)
    return _numbers(spark, sf).select("k", params.number(p, "num_lines").alias("num_lines"), params.number(p, "num_rng_bins").alias("bins"), value("clock_start").alias("clock_start"), value("clock_stop").alias("clock_stop"))


# ---- grids and geometry


@query("SELECT y, x, v FROM total WHERE y < 8")
def same_grid(spark, sf):
    """The cells of one grid at those of another, by computed indexes."""
    target = S.total(spark, sf).filter("y < 8").select((F.col("y") + 0.25).alias("y"), (F.col("x") - 0.25).alias("x"))
    return raster.same_grid(S.total(spark, sf), GRID, target, ["v"]).select(F.round("y").alias("y"), F.round("x").alias("x"), "v")


@query("SELECT date, y, x, v FROM stack WHERE (y > 1.5e0 AND x > 1.5e0 AND x + y < 11.5e0) OR (x BETWEEN 1.5e0 AND 10e0 AND y BETWEEN 1e0 AND 1.5e0) OR (y BETWEEN 1.5e0 AND 10e0 AND x BETWEEN 1e0 AND 1.5e0) OR (x + y BETWEEN 11.5e0 AND 11.5e0 + 0.5e0 * sqrt(2) AND x >= 1.5e0 AND y >= 1.5e0)")
def polygon_clip(spark, sf):
    """Cells within a triangle and a buffer around it."""
    return stats.clip_polygon(S.stack(spark, sf), [(1.5, 1.5), (10.0, 1.5), (1.5, 10.0)], 0.5)


@query("SELECT 'azi' AS axis, CAST(2 + 4 * i AS DOUBLE) AS value FROM range(0, 250) t(i) UNION ALL SELECT 'rng', CAST(4 + 8 * i AS DOUBLE) FROM range(0, 63) t(i)", base=False)
def transform_axes(spark, sf):
    """The axes of a transform table."""
    azi, rng = geocode.trans_grid(spark, 1000, 500, (4, 8))
    return azi.select(F.lit("azi").alias("axis"), F.col("azi").alias("value")).unionByName(rng.select(F.lit("rng").alias("axis"), F.col("rng").alias("value")))


GEO = {"earth_radius": 6371000.0, "SC_height": 693000.0, "SC_vel": 7600.0, "rng_samp_rate": 64000000.0, "near_range": 800000.0, "num_rng_bins": 20000.0}


@query(f"""WITH n AS (SELECT n_nationkey AS k, 400 + 10e0 * n_nationkey AS prf FROM nation),
g AS (SELECT k, prf, 7600e0 / sqrt(1 + 693000e0 / 6371000e0) / prf AS a, 7064000e0 AS c, 800000e0 + {STEP} * 10000 AS m FROM n),
s AS (SELECT *, {STEP} / sin(acos((c * c + m * m - 6371000e0 * 6371000e0) / (2 * c * m)) + acos((c * c + 6371000e0 * 6371000e0 - m * m) / (2 * c * 6371000e0))) AS b FROM g)
SELECT CAST(k AS INTEGER) AS k, round(a, 6) + 0e0 AS azimuth, round(4 * b, 6) + 0e0 AS ground, CAST(greatest(1, round(60 / a)) AS INTEGER) AS fy, CAST(CASE WHEN greatest(1, round(60 / (4 * b))) > 4 THEN 4 * greatest(1, round(greatest(1, round(60 / (4 * b))) / 4)) ELSE greatest(1, round(60 / (4 * b))) END AS INTEGER) AS fx,
  round(exp(-0.5e0 * (k % 5 - 2) * (k % 5 - 2)), 9) + 0e0 AS kernel FROM s""", base=False)
def pixel_sizes(spark, sf):
    """Ground size of pixels, decimation factors from metres, and a row of a Gaussian kernel, for 25 pulse rates."""
    rows, kernel = [], geometry.gaussian_kernel((5, 5), (1, 1))
    for x in table(spark, sf, "nation").collect():  # a table of nations
        a, b = geometry.pixel_spacing(GEO | {"PRF": 400 + 10.0 * x.n_nationkey}, (1, 4))
        fy, fx = geometry.coarsen_factors((60.0, 60.0), (a, b))
        rows.append((x.n_nationkey, round(a, 6), round(b, 6), fy, fx, round(float(kernel[2, x.n_nationkey % 5]), 9)))
    return spark.createDataFrame(rows, "k int, azimuth double, ground double, fy int, fx int, kernel double")


@query("SELECT 'lat, lon' AS axes, CAST(4326 AS INTEGER) AS epsg, TRUE AS geographic, FALSE AS radar, count(*) AS n FROM total UNION ALL SELECT 'y, x', 3857, FALSE, TRUE, count(*) FROM total")
def reference_systems(spark, sf):
    """The reference system that a grid's axes imply."""
    out = None
    for g in (_geo(spark, sf), S.total(spark, sf)):
        axes = ", ".join(c for c in g.columns if c != "v")
        one = g.agg(F.count("*").alias("n")).select(F.lit(axes).alias("axes"), F.lit(export.reference_system(g.columns)).alias("epsg"), F.lit(export.is_geo(g.columns)).alias("geographic"), F.lit(export.is_radar(g.columns)).alias("radar"), "n")
        out = one if out is None else out.unionByName(one)
    return out


OTHER = {"near_range": 801000.0, "num_rng_bins": 21000.0}


@query(f"""WITH n AS (SELECT n_nationkey AS k, CAST(n_nationkey * 10 AS DOUBLE) AS len, n_nationkey * 7e0 AS alpha FROM nation),
a AS (SELECT *, 7064000e0 AS c, 801000e0 AS l1, 801000e0 + {STEP} * 21000 AS l2 FROM n),
g AS (SELECT *, acos(((l1 * l1 + c * c - 6371000e0 * 6371000e0) / (2 * l1 * c) + (l2 * l2 + c * c - 6371000e0 * 6371000e0) / (2 * l2 * c)) / 2) + acos(((c * c + 6371000e0 * 6371000e0 - l1 * l1) / (2 * c * 6371000e0) + (c * c + 6371000e0 * 6371000e0 - l2 * l2) / (2 * c * 6371000e0)) / 2) - radians(alpha) AS angle FROM a)
SELECT CAST(k AS INTEGER) AS k, round(len * sin(angle), 6) + 0e0 AS parallel, round(len * cos(angle), 6) + 0e0 AS perpendicular, round((k * 1000e0 + 2000) / sqrt(2), 6) + 0e0 AS vertical, round(abs(k * 1000e0 - 2000) / sqrt(2) * CASE WHEN k * 1000 + 2000 < 0 THEN 1 ELSE 1 END, 6) + 0e0 AS horizontal,
  round(700000e0 + k * 1000, 3) + 0e0 AS height, round(86400 * (k + 0.5e0) + (k + 0.25e0 + (2000 - 1500) / 2e0) / 500, 6) + 0e0 AS start, round(86400 * (k + 0.5e0) + (k + 0.25e0 + (2000 - 1500) / 2e0) / 500 + 1500 / 500e0, 6) + 0e0 AS stop FROM g""", base=False)
def baseline_numbers(spark, sf):
    """Baselines in parts, height over the ellipsoid and a scene's seconds, for 25 sets of numbers."""
    rows = []
    for x in table(spark, sf, "nation").collect():  # a table of nations
        k = x.n_nationkey
        par, perp = geometry.baseline_projections(GEO, OTHER, k * 10.0, k * 7.0)
        up, side = geometry.baseline_components((k * 1000.0, 2000.0, 0.0), (5e6, 5e6, 0.0), (5e6, 5.1e6, 0.0), False, False)
        height, _ = geometry.ellipsoid_height(6378137.0 + 700000.0 + k * 1000, 0.0, 0.0)
        start, stop = geometry.scene_seconds({"clock_start": k + 0.5, "ashift": k, "sub_int_a": 0.25, "nrows": 2000, "num_valid_az": 1500, "PRF": 500, "num_patches": 1})
        rows.append((k, *(round(float(v), 6) + 0.0 for v in (par, perp, up, side)), round(float(height), 3), round(start, 6), round(stop, 6)))
    return spark.createDataFrame(rows, "k int, parallel double, perpendicular double, vertical double, horizontal double, height double, start double, stop double")


@query(f"""WITH n AS (SELECT n_nationkey AS k, CAST((190 + n_nationkey) / 86400e0 AS DOUBLE) AS clock FROM nation), t AS (SELECT k, clock * 86400 + f * 2000 / 486.5e0 AS t, f FROM n, (VALUES (0e0), (0.5e0), (1e0)) u(f)),
z AS (SELECT k, f, 7064000e0 * sin((t - 200) * ({2 * 3.141592653589793!r}e0 / 5900)) / 7064000e0 AS s FROM t), b AS (SELECT k, f, 1 / sqrt((1 - s * s) / (6378137e0 * 6378137e0) + s * s / (6356752.31424518e0 * 6356752.31424518e0)) AS below FROM z)
SELECT CAST(k AS INTEGER) AS k, round(any_value(7064000e0 * {2 * 3.141592653589793!r}e0 / 5900), 2) AS speed, round(max(CASE WHEN f = 0.5e0 THEN below END), 1) AS earth_radius, round(7064000e0 - max(CASE WHEN f = 0.5e0 THEN below END), 1) AS height FROM b GROUP BY k""", base=False)
def orbit_derived(spark, sf):
    """Speed, Earth radius and height that a scene's orbit says, for 25 starts on a circle."""
    rows = []
    for x in table(spark, sf, "nation").collect():  # a table of nations
        f = geocode.orbit_numbers(_orbit(spark), {"clock_start": (190 + x.n_nationkey) / 86400, "PRF": 486.5, "num_lines": 2000})
        rows.append((x.n_nationkey, round(f["SC_vel"], 2), round(f["earth_radius"], 1), round(f["SC_height"], 1)))
    return spark.createDataFrame(rows, "k int, speed double, earth_radius double, height double")


# ---- alignment


@query(f""", {DEM}, {_radar('dem')} SELECT lat, lon, {r('-35.5e0', 4)} AS d_azimuth, {r('-20.25e0', 4)} AS d_range, CAST(-36 AS DOUBLE) AS ashift, 0.5e0 AS sub_int_a, CAST(-21 AS DOUBLE) AS rshift, 0.75e0 AS sub_int_r, {r('-35.5e0', 3)} AS dy, {r('-20.25e0', 3)} AS dx FROM trans WHERE {IN_SCENE}""")
def alignment(spark, sf):
    """Offsets of a repeat scene that starts later and farther, the shifts fitted to them, and those at the cells."""
    one = geocode.transform(_dem(spark, sf), _orbit(spark), _scene())
    later = _scene() | {"clock_start": _scene()["clock_start"] + 35.5 / 486.5 / 86400, "near_range": 700000.0 + 20.25 * SPEED_OF_LIGHT / _scene()["rng_samp_rate"] / 2}
    two = geocode.transform(_dem(spark, sf), _orbit(spark), later)
    offsets = align.offsets_between(one, two)
    fit = regression.fit_offsets(offsets, 1, 1)
    shifts = align.fitted_shifts(one.select(F.col("azi").alias("y"), F.col("rng").alias("x")), fit)
    out = one.join(shifts, (one["azi"] == shifts["y"]) & (one["rng"] == shifts["x"])).join(offsets, (one["azi"] == offsets["azimuth"]) & (one["rng"] == offsets["range"]))
    numbers = [F.lit(float(round(fit[k], 6))).alias(k) for k in ("ashift", "sub_int_a", "rshift", "sub_int_r")]
    return rounded(rounded(out.select("lat", "lon", "d_azimuth", "d_range", *numbers, "dy", "dx"), "d_azimuth", "d_range", digits=4), "dy", "dx", digits=3)


@query(f""", t AS (SELECT s.date, yy.y, xx.x, sum(s.re * a.w * b.w) AS re, sum(s.im * a.w * b.w) AS im, count(*) AS n FROM range(12) yy(y), range(10) xx(x), (VALUES (0, 0.75e0), (1, 0.25e0)) a(k, w), (VALUES (0, 0.5e0), (1, 0.5e0)) b(k, w), slc s
  WHERE s.y = least(yy.y + a.k, 11) AND s.x = least(xx.x + b.k, 9) GROUP BY ALL)
SELECT date, CAST(y AS DOUBLE) AS y, CAST(x AS DOUBLE) AS x, {r('re', 4)} AS re, {r('im', 4)} AS im FROM t WHERE n = 4""")
def resampled(spark, sf):
    """Scenes resampled at cells moved by a quarter line and half a column."""
    shifts = S.total(spark, sf).select("y", "x", F.lit(0.25).alias("dy"), F.lit(0.5).alias("dx"))
    out = align.resampled(S.slc(spark, sf), ["re", "im"], shifts, GRID, "linear", ["date"])
    return rounded(out.filter("re IS NOT NULL"), "re", "im", digits=4)


@query(f""", k AS (SELECT y, x, v, row_number() OVER (PARTITION BY y, x ORDER BY v) AS n FROM total) SELECT y, x, v / 64 AS topo FROM k""")
def topography(spark, sf):
    """The heights of an inverse transform."""
    inv = S.total(spark, sf).select("y", "x", F.lit(0.0).alias("lt"), F.lit(0.0).alias("ll"), (F.col("v") / 64).alias("ele"))
    store = Store(spark, new_path(spark, "store"))
    return geocode.topo_of(store.sync_cube(inv, "trans_inv"))


@query("""SELECT strftime(min(date), '%Y-%m-%d') AS date, CAST(500 AS DOUBLE) AS prf, CAST(1001 AS BIGINT) AS bins, CAST(1508 AS BIGINT) AS num_lines, CAST(1001 + 999 - 1 - 1 AS BIGINT) AS merged_bins FROM scenes""")
def session_parameters(spark, sf):
    """Parameters of a session's reference date and first subswath, and the extent of its merged subswaths: the first starts 7
    lines later than the second, whose near range is all but one bin farther."""
    one = _session(spark, sf)
    s = F.col("id").cast("int")
    step = SPEED_OF_LIGHT / 64000000 / 2
    values = {"PRF": F.lit(500.0), "clock_start": 100 + (2 - s) * 7 / 500.0 / 86400, "SC_clock_start": F.lit(1.0), "near_range": 800000 + (s - 1) * 1000 * step, "rng_samp_rate": F.lit(64000000.0), "num_rng_bins": F.lit(1003) - s * 2, "num_valid_az": F.lit(1501)}
    one.parameters = spark.range(1, 3).select(F.lit(one.reference).alias("date"), s.alias("subswath"), F.create_map(*(x for n, v in values.items() for x in (F.lit(n), v.cast("string")))).alias("params"))
    number = lambda n: params.number(F.col("params"), n)
    merged = one.params_merged().select("date", number("num_lines").alias("num_lines"), number("num_rng_bins").alias("merged_bins"))
    return one.params_of().select("date", number("PRF").alias("prf"), number("num_rng_bins").alias("bins")).join(merged, "date")


# ---- fits and series


@query("SELECT date, median(v) AS stack_average FROM stack GROUP BY date")
def amplitude_medians(spark, sf):
    """One number for each date by a function of the caller's."""
    return stats.date_means(S.stack(spark, sf), "v", F.median)


@query(f""", f AS (SELECT pair, count(*) AS n, avg(x) AS m, stddev_pop(x) AS s, avg(phase) AS p, covar_pop(x, phase) / stddev_pop(x) AS q FROM data GROUP BY pair)
SELECT d.pair, d.y, d.x, CASE WHEN f.n >= 20 THEN {r('f.p + sign(f.q) * greatest(0, abs(f.q) - 0.3e0 * 0.5e0) / (1 + 0.3e0 * 0.5e0) * (d.x - f.m) / f.s', 5)} END AS model FROM data d JOIN f ON f.pair = d.pair""")
def regression_elastic(spark, sf):
    """The elastic net of one variable, whose optimum is a soft threshold."""
    out = regression.regression_sgd(S.pair_data(spark, sf), "phase", ["x"], ["pair"], least=20, alpha=0.3, l1_ratio=0.5, tol=1e-12)
    return rounded(out.select("pair", "y", "x", "model"), "model", digits=5)


SEASON = "CASE {0} % 7 WHEN 0 THEN 3 WHEN 1 THEN -1 WHEN 2 THEN 2 WHEN 3 THEN -4 WHEN 4 THEN 1 WHEN 5 THEN 0 ELSE -1 END"


@query(f", d AS (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS t FROM scenes), e AS (SELECT CAST(t AS DATE) AS date, date_diff('day', DATE '2024-01-01', CAST(t AS DATE)) AS n FROM d) SELECT e.date, t.y, t.x, {r('t.v / 64 + (t.x + 1) / 8 * e.n', 5)} AS trend, {r('(t.y + 1) * (' + SEASON.format('e.n') + ')', 5)} AS seasonal, CAST(0 AS DOUBLE) AS resid FROM total t, e")
def seasonal_parts(spark, sf):
    """A line with a weekly cycle, which local regressions of degree 1 take apart exactly."""
    days = stl.regular_dates(S.scenes(spark, sf), "D").select("date", F.datediff("date", F.lit("2024-01-01").cast("date")).alias("n"))
    rows = S.total(spark, sf).join(F.broadcast(days), F.lit(True))
    cycle = F.element_at(F.array(*(F.lit(float(x)) for x in (3, -1, 2, -4, 1, 0, -1))), F.col("n") % 7 + 1)
    series = rows.select("date", "y", "x", (F.col("v") / 64 + (F.col("x") + 1) / 8 * F.col("n") + (F.col("y") + 1) * cycle).alias("v"))
    return rounded(stl.stl(series, "v", freq="D", period=7), "trend", "seasonal", "resid", digits=5)


@query(f"""WITH o AS (SELECT CAST(c_custkey AS DOUBLE) AS rng, CAST(c_nationkey * 40 AS DOUBLE) AS azi FROM customer), b AS (SELECT min(rng) AS x0, max(rng) AS x1, min(azi) AS y0, max(azi) AS y1 FROM o)
SELECT CAST(5 AS DOUBLE) AS rshift, {r('0.25e0', 4)} AS sub_int_r, {r('0.001e0', 7)} AS stretch_r, {r('0.0005e0', 7)} AS a_stretch_r, CAST(-3 AS DOUBLE) AS ashift, {r('0.5e0', 4)} AS sub_int_a, {r('-0.002e0', 7)} AS stretch_a, {r('0.0004e0', 7)} AS a_stretch_a FROM b""", base=False)
def fitted_offsets(spark, sf):
    """Shifts and stretches from offsets that lie on planes, with others of low signal-to-noise among them."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("double").alias("range"), (F.col("c_nationkey") * 40).cast("double").alias("azimuth"))
    good = c.select("*", (5.25 + 0.001 * F.col("range") + 0.0005 * F.col("azimuth")).alias("d_range"), (-2.5 - 0.002 * F.col("range") + 0.0004 * F.col("azimuth")).alias("d_azimuth"), F.lit(40.0).alias("snr"))
    bad = c.select("*", F.lit(99.0).alias("d_range"), F.lit(-99.0).alias("d_azimuth"), F.lit(3.0).alias("snr"))
    found = regression.fit_offsets(good.unionByName(bad), 3, 3)
    names = [*(f"{k}" for k in ("rshift", "sub_int_r", "stretch_r", "a_stretch_r", "ashift", "sub_int_a", "stretch_a", "a_stretch_a"))]
    out = spark.createDataFrame([tuple(float(found[n]) for n in names)], ", ".join(f"{n} double" for n in names))
    return rounded(rounded(out, "sub_int_r", "sub_int_a", digits=4), "stretch_r", "a_stretch_r", "stretch_a", "a_stretch_a", digits=7)


@query(", b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM total) SELECT 0.25e0 + 0.5e0 * ((x0 + x1) / 2 - 4.5e0) - 0.125e0 * ((y0 + y1) / 2 - 5.5e0) AS c0, 0.5e0 * (x1 - x0) / 2 AS cx, -0.125e0 * (y1 - y0) / 2 AS cy, x0, x1, y0, y1 FROM b")
def plane(spark, sf):
    """A plane through points that lie on one, by re-weighting."""
    t = S.total(spark, sf).select("x", "y", (0.25 + 0.5 * (F.col("x") - 4.5) - 0.125 * (F.col("y") - 5.5)).alias("z"))
    coef, box = regression.robust_plane(t)
    return spark.createDataFrame([tuple(round(x + 0.0, 6) for x in (*coef, *box))], "c0 double, cx double, cy double, x0 double, x1 double, y0 double, y1 double")


@query(f"SELECT p.pair, t.y, t.x, {r('0.9e0 * t.y + 0.7e0 * t.x', 4)} AS phase FROM pairs p, total t")
def unwrap_ramp(spark, sf):
    """Two-dimensional unwrapping over several tiles of a ramp, up to the whole turns of its first cell."""
    from fringework.functions import columns as C

    p = F.broadcast(S.pairs(spark, sf).select("ref", "rep", "pair", "duration"))
    d = S.total(spark, sf).join(p, F.lit(True)).select("ref", "rep", "pair", "y", "x", C.wrap(0.9 * F.col("y") + 0.7 * F.col("x") + F.col("duration")).alias("phase"), F.lit(0.9).alias("correlation"))
    out = unwrap2d.unwrap2d(d, config=unwrap2d.Config(tile=6))
    first = out.filter("y = 0 AND x = 0").select("pair", F.col("phase").alias("origin"))
    return rounded(out.join(F.broadcast(first), "pair").select("pair", "y", "x", (F.col("phase") - F.col("origin")).alias("phase")), "phase", digits=4)


@query(f""", s AS (SELECT date, v, row_number() OVER (ORDER BY date) AS n FROM stack WHERE y = 4 AND x = 5), c AS (SELECT date AS ref, lead(date) OVER (ORDER BY date) AS rep FROM scenes),
d AS (SELECT c.rep AS date, (b.v - a.v) / 64 AS v FROM c JOIN s a ON a.date = c.ref JOIN s b ON b.date = c.rep),
h AS (SELECT s.date, {DAY.replace('date)', 's.date)')} AS t, coalesce(sum(d.v) OVER (ORDER BY s.date), 0) AS v FROM scenes s LEFT JOIN d ON d.date = s.date), f AS (SELECT avg(v) AS mv, avg(t) AS mt, regr_slope(v, t) AS b FROM h)
SELECT h.date, 4e0 AS y, 5e0 AS x, {r('-79.58e0 * 0.0554658e0 * h.v', 2)} AS displacement, {r('-79.58e0 * 0.0554658e0 * (f.mv + f.b * (h.t - f.mt))', 2)} AS line, {r('-79.58e0 * 0.0554658e0 * f.b * 365.25e0', 1)} AS velocity, CAST(0 AS DOUBLE) AS rmse FROM h, f""")
def displacement_report(spark, sf):
    """The history of the pixel nearest to a place from a chain of pairs, its line, velocity and the pairs' agreement, in millimetres."""
    p = P.consecutive_pairs(S.scenes(spark, sf))
    s = S.stack(spark, sf)
    one = s.select(F.col("date").alias("ref"), "y", "x", F.col("v").alias("v1")).join(F.broadcast(p), "ref")
    d = one.join(s.select(F.col("date").alias("rep"), "y", "x", F.col("v").alias("v2")), ["rep", "y", "x"]).select("ref", "rep", "y", "x", ((F.col("v2") - F.col("v1")) / 64).alias("phase"))
    out = report.displacement_report(d, 4.2, 5.1, wavelength=0.0554658, unwrap=False, pairs=p)
    return rounded(rounded(rounded(out, "displacement", "line", digits=2), "velocity", digits=1), "rmse", digits=1)
