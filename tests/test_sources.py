"""Sources, stores, sessions, streams and geocoding."""

import datetime as dt
import gzip
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringework.operators import geocode
from fringework.operators.raster import Grid
from fringework.session import Fan, Session
from fringework.sources import catalog, formats, rasters
from fringework.sources.store import Store
from fringework.streaming import scenes as streams


def test_samples(spark, tmp_path):
    a = np.arange(24, dtype="<i2").reshape(3, 4, 2)
    (tmp_path / "x.slc").write_bytes(a.tobytes())
    rows = {(r.y, r.x): (r.re, r.im) for r in rasters.read_samples(spark, str(tmp_path / "x.slc"), 4, (4, 5), scale=1.0).collect()}
    assert len(rows) == 20 and rows[0.5, 1.5] == (2.0, 3.0) and rows[2.5, 3.5] == (22.0, 23.0)
    assert rows[3.5, 0.5] == (None, None) and rows[0.5, 4.5] == (None, None)


def test_orbit_file(spark, tmp_path):
    (tmp_path / "o.led").write_text("2 2020 357 100 10\n2020 357 100.0 1 2 3 4 5 6\n2020 357 110.0 2 3 4 5 6 7\n")
    got = rasters.read_orbit(spark, str(tmp_path / "o.led")).orderBy("clock").collect()
    assert [r.clock for r in got] == [357 * 86400 + 100, 357 * 86400 + 110] and got[1].vz == 7


def test_annotation(spark, tmp_path):
    points = "".join(f"<geolocationGridPoint><azimuthTime>2024-01-01T00:00:0{k}</azimuthTime><line>{k // 2}</line><pixel>{k % 2}</pixel><latitude>{k}.5</latitude><longitude>{k}</longitude></geolocationGridPoint>" for k in range(6))
    (tmp_path / "a.xml").write_text(f"<product><grid>{points}</grid></product>")
    got = catalog.geolocation(spark, str(tmp_path / "a.xml"))
    assert got.count() == 6 and got.filter("latitude = 3.5").first().point.lon == 3.0
    rings = catalog.bursts(got.select(F.col("longitude").alias("n"), "line", F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))).collect()
    assert len(rings) == 2 and all(len(r.ring) == 5 and r.ring[0] == r.ring[-1] for r in rings)


def test_scan(spark, tmp_path):
    base = "s1a-iw1-slc-vv-{d}t120000-{d}t120020-012345-0abcde-004"
    for d in ("20240105", "20240117"):
        for e in ("tiff", "xml"):
            (tmp_path / f"{base.format(d=d)}.{e}").write_text("x")
    (tmp_path / "S1A_OPER_AUX_POEORB_OPOD_20240125T000000_V20240104T225942_20240106T005942.EOF").write_text("x")
    (tmp_path / "S1A_OPER_AUX_RESORB_OPOD_20240117T150000_V20240117T100000_20240117T140000.EOF").write_text("x")
    got = catalog.scan(spark, str(tmp_path)).collect()
    assert [r.date for r in got] == ["2024-01-05", "2024-01-17"] and "POEORB" in got[0].orbitpath and "RESORB" in got[1].orbitpath
    assert got[0].metapath.endswith(".xml") and got[0].mission == "S1A" and got[0].subswath == 1


def test_catalog_problems(spark):
    rows = [("2024-01-01", "S1A", 1, "A"), ("2024-01-01", "S1B", 3, "A"), ("2024-01-13", "S1A", 1, "D")]
    got = {r.problem for r in catalog.problems(spark.createDataFrame(rows, "date string, mission string, subswath int, orbit string")).collect()}
    assert got == {"several missions on one date", "subswaths aren't sequential", "several orbits"}


def test_tiles(spark):
    lat, lon = rasters.degree_name(F.lit(-1.5), F.lit(10.2))
    assert spark.range(1).select(F.concat(lat, lon)).first()[0] == "S02E010"
    boxes = spark.createDataFrame([(9.5, -1.5, 11.0, 0.0)], "minx double, miny double, maxx double, maxy double")
    assert {r.tile for r in rasters.degree_tiles(boxes).collect()} == {"S02E009", "S02E010", "S01E009", "S01E010"}
    assert rasters.web_tiles(boxes, 0).count() == 1
    assert rasters.height_preset("GLO") == "dem_glo"
    with pytest.raises(ValueError):
        rasters.height_preset("X")


def test_height_models(spark):
    model = spark.createDataFrame([(float(y), float(x), float("nan") if (y, x) == (1, 1) else 10.0) for y in range(4) for x in range(4)], "lat double, lon double, ele double")
    clean = rasters.clean_model(model, box=(0.0, 0.0, 2.0, 2.0))
    assert clean.count() == 9 and clean.filter("ele IS NULL").count() == 1 and rasters.repeated(model).isEmpty()
    geoid = spark.createDataFrame([(float(y), float(x), 0.5 * y) for y in range(4) for x in range(4)], "lat double, lon double, geoid double")
    high = rasters.over_ellipsoid(clean, geoid, Grid(0, 1, 4, 0, 1, 4))
    assert high.filter("lat = 2 AND lon = 0").first().ele == 11.0


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    d = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "pair string, v double")
    s.save_stack(d, "phase")
    s.save_stack(spark.createDataFrame([("b", 3.0)], "pair string, v double"), "phase")
    assert {(r.pair, r.v) for r in s.open_stack("phase").collect()} == {("a", 1.0), ("b", 3.0)}
    assert s.open_stack("phase", ["a"]).count() == 1 and s.names() == ["phase"]
    assert [r.pair for r in s.missing_slices(spark.createDataFrame([("a",), ("c",)], "pair string"), "phase").collect()] == ["c"]
    assert s.sync_cube(d, "cube").count() == 2
    s.delete_cube("cube")
    with pytest.raises(FileNotFoundError):
        s.open_cube("cube")


def test_session(spark, tmp_path):
    one = Session(spark, str(tmp_path / "w"))
    rows = [("2024-01-05", 1, "o", 0.0), ("2024-01-17", 1, "o", 5.0), ("2024-01-17", 2, "o", 5.0)]
    scenes = spark.createDataFrame(rows, "date string, subswath int, orbitpath string, bperp double")
    one.set_scenes(scenes)
    assert one.reference == "2024-01-05" and one.get_subswaths() == [1, 2] and one.get_repeat(1).count() == 1
    with pytest.raises(ValueError):
        one.set_reference("2020-01-01")
    with pytest.raises(ValueError):
        one.set_scenes(scenes.withColumn("orbitpath", F.lit(None).cast("string")))
    one.dump()
    assert Session.restore(spark, str(tmp_path / "w")).reference == "2024-01-05"
    with pytest.raises(FileExistsError):
        Session(spark, str(tmp_path / "w"))
    with Fan(one, one) as fan:
        assert fan.get_subswaths() == [[1, 2], [1, 2]]
        fan.set_context(subswath=[1, 2])
        assert [x.count() for x in fan.run_method("get_repeat")] == [1, 1]
        with pytest.raises(ValueError):
            fan.set_context(subswath=[1])


def test_stream_of_scenes(spark, tmp_path):
    folder, store = str(tmp_path / "in"), Store(spark, str(tmp_path / "out"))
    schema = "date date, bperp double"

    def arrive(*days):
        spark.createDataFrame([(dt.date(2024, 1, d), 0.0) for d in days], schema).write.mode("append").parquet(folder)
        q = streams.extend_network(streams.watch(spark, folder, spark.createDataFrame([], schema).schema), store, 12, None, str(tmp_path / "cp"))
        assert q.awaitTermination(120)

    arrive(1, 13)
    arrive(25, 13)
    assert {(r.ref.day, r.rep.day) for r in store.open_cube("network").collect()} == {(1, 13), (13, 25)}


def test_geocoding_goes_there_and_back(spark):
    import math

    t = np.arange(0, 410, 10.0)
    a = (t - 200) * (2 * math.pi / 5900)
    w = 7064000.0 * 2 * math.pi / 5900
    orbit = spark.createDataFrame([(float(x), 7064000.0 * math.cos(b), 0.0, 7064000.0 * math.sin(b), -w * math.sin(b), 0.0, w * math.cos(b)) for x, b in zip(t.tolist(), a.tolist(), strict=True)], "clock double, px double, py double, pz double, vx double, vy double, vz double")
    params = {"PRF": 486.5, "clock_start": 190 / 86400, "rng_samp_rate": 64345238.0, "near_range": 700000.0, "num_lines": 20000, "num_rng_bins": 200000}
    dem = spark.createDataFrame([(y / 50, 4 + x / 50, 0.0) for y in range(6) for x in range(6)], "lat double, lon double, ele double")
    trans = geocode.transform(dem, orbit, params)
    assert trans.count() == 36
    target = trans.select(F.col("azi").alias("y"), F.col("rng").alias("x"), F.col("lat").alias("lat0"))
    back = geocode.inverse(trans, target, (5.0, 5.0)).filter("lt IS NOT NULL")
    assert back.count() == 36
    look = geocode.look_vectors(dem, orbit).collect()
    assert all(abs(r.look_E**2 + r.look_N**2 + r.look_U**2 - 1) < 1e-9 and r.look_U > 0 and r.look_E < 0 for r in look)
    tide = geocode.tide(np.array([0.0, 90.0]), np.array([0.0, 45.0]), 8000.25)
    assert np.abs(tide).max() < 0.6 and np.abs(tide).max() > 0.01


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_raster_files_come_back(spark, tmp_path):
    r = np.random.default_rng(2)
    g = Grid(10.25, 0.5, 33, -3.5, 0.25, 41)
    cells = {(y, x): float(np.float32(r.normal())) for y in range(33) for x in range(41) if r.random() < 0.8 and not (16 <= y < 32 and x < 16)}
    df = spark.createDataFrame([(10.25 + 0.5 * y, -3.5 + 0.25 * x, v if (y + x) % 7 else None) for (y, x), v in cells.items()], "lat double, lon double, v double").withColumn("path", F.lit("clash"))
    want = {(10.25 + 0.5 * y, -3.5 + 0.25 * x): (cells[y, x] if (y + x) % 7 else None) if (y, x) in cells else None for y in range(33) for x in range(41)}
    for write, read, more in ((formats.write_geotiff, formats.read_geotiff, {"tile": 16}), (formats.write_netcdf, formats.read_netcdf, {})):
        path = str(tmp_path / write.__name__)
        write(df, path, "v", g, **more)
        got = {(x.lat, x.lon): x.v for x in read(formats.files(spark, path)).collect()}
        assert got == want
        write(df.filter("false"), path, "v", g, **more)
        empty = read(formats.files(spark, path)).collect()
        assert len(empty) == 33 * 41 and all(x.v is None for x in empty)
    raw = (tmp_path / "write_geotiff").read_bytes()
    _, tags = formats._tags(raw)
    assert tags[256] == (41,) and tags[257] == (33,) and tags[33922][3:5] == (-3.625, 26.5) and tags[34735][-1] == 4326
    with pytest.raises(Exception, match="classic NetCDF"):
        formats.read_netcdf(formats.files(spark, str(tmp_path / "write_geotiff"))).collect()


def test_plain_strips_of_whole_numbers(spark, tmp_path):
    """A classic TIFF in big-endian order with two strips, written by hand."""
    a = np.array([[1, 2, -9], [4, 5, 6]], ">i2")
    tags = [(256, 3, 1, 3 << 16), (257, 3, 1, 2 << 16), (258, 3, 1, 16 << 16), (259, 3, 1, 1 << 16), (273, 4, 2, 158), (277, 3, 1, 1 << 16), (278, 3, 1, 1 << 16), (279, 4, 2, 166), (339, 3, 1, 2 << 16), (33550, 12, 3, 174), (33922, 12, 6, 198), (42113, 2, 3, int.from_bytes(b"-9\0\0", "big"))]
    head = struct.pack(">2sHIH", b"MM", 42, 8, len(tags)) + b"".join(struct.pack(">HHII", *t) for t in tags) + struct.pack(">I", 0)
    body = head.ljust(158, b"\0") + struct.pack(">4I", 248, 254, 6, 6) + struct.pack(">3d", 0.5, 0.25, 0) + struct.pack(">6d", 0, 0, 0, 10, 20, 0)
    (tmp_path / "a.tif").write_bytes(body.ljust(248, b"\0") + a.tobytes())
    got = {(x.lat, x.lon): x.v for x in formats.read_geotiff(formats.files(spark, str(tmp_path / "a.tif"))).collect()}
    assert got == {(19.875, 10.25): 1, (19.875, 10.75): 2, (19.875, 11.25): None, (19.625, 10.25): 4, (19.625, 10.75): 5, (19.625, 11.25): 6}


def test_height_tiles(spark, tmp_path):
    a = (np.arange(9).reshape(3, 3) * 10).astype(">i2")
    a[1, 1] = -32768
    (tmp_path / "S02W003.hgt").write_bytes(a.tobytes())
    (tmp_path / "N05E010.hgt.gz").write_bytes(gzip.compress(a.tobytes()))
    with zipfile.ZipFile(tmp_path / "N00E000.zip", "w") as z:
        z.writestr("N00E000.hgt", a.tobytes())
    got = {(x.lat, x.lon): x.ele for x in formats.height_tiles(formats.files(spark, str(tmp_path))).collect()}
    assert len(got) == 27 and got[-1.0, -3.0] == 0 and got[-2.0, -2.0] == 80 and got[5.5, 10.5] is None and got[6.0, 11.0] == 20 and got[0.0, 0.5] == 70
