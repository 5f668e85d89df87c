"""Operators against hand-made truths on small fixtures."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringework.functions import columns as C
from fringework.functions import geometry
from fringework.operators import export, inversion, params, phase, raster, regression, stats, stl, unwrap2d
from fringework.operators import pairs as P
from fringework.operators.raster import Grid

START = dt.date(2024, 1, 1)


def day(n):
    return START + dt.timedelta(n)


@pytest.fixture(scope="module")
def scenes(spark):
    """Twelve dates at 12-day steps with one gap of 36 days."""
    steps = [0, 12, 24, 36, 48, 84, 96, 108, 120, 132, 144, 156]
    return spark.createDataFrame([(day(s), float(i * 10 % 70)) for i, s in enumerate(steps)], "date date, bperp double")


def grid(spark, a, name="v"):
    rows = [(float(y), float(x), None if np.isnan(a[y, x]) else float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, f"y double, x double, {name} double")


def dense(df, shape, name="v"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        if r[name] is not None:
            out[round(r.y), round(r.x)] = r[name]
    return out


# ---- networks


def test_pairs_by_hand(scenes):
    got = P.make_pairs(scenes, days=24, meters=25).collect()
    rows = [(r.date, r.bperp) for r in scenes.collect()]
    want = {(a, b) for a, x in rows for b, y in rows if a < b and (b - a).days < 25 and abs(x - y) < 26}
    assert {(r.ref, r.rep) for r in got} == want and len(got) == len(want)
    assert all(r.pair == f"{r.ref} {r.rep}" and r.duration == (r.rep - r.ref).days for r in got)
    back = P.make_pairs(scenes, days=24, invert=True).collect()
    assert all(r.duration < 0 for r in back)
    assert P.make_pairs(scenes).count() == 66


def test_degree_limit_removes_hanging_dates(spark):
    ring = [(0, 12), (12, 24), (24, 36), (0, 36), (36, 48)]
    p = P.normalise([(day(a), day(b)) for a, b in ring], spark)
    assert {(r.ref, r.rep) for r in P.limit_degree(p, 2).collect()} == {(day(a), day(b)) for a, b in ring[:-1]}


def test_uncovered_and_matrices(spark):
    p = P.normalise([(day(0), day(12)), (day(24), day(36))], spark)
    assert [(r.ref, r.rep) for r in P.uncovered(p).collect()] == [(day(12), day(24))]
    codes = {(r.pair[:10], r.date): r.code for r in P.incidence(p).collect()}
    assert codes[str(day(0)), day(0)] == -1 and codes[str(day(0)), day(12)] == 1 and codes[str(day(0)), day(24)] is None
    assert sum(r.code for r in P.inversion_matrix(p).collect()) == 2


def test_extend_and_cover(spark, scenes):
    p = P.make_pairs(scenes, days=12)
    e = P.extend(p)
    assert {(r.ref, r.rep, r.rel) for r in e.filter("rel IS NOT NULL").collect()} == {(day(a), day(a + 24), day(a + 12)) for a in (0, 12, 24, 84, 96, 108, 120, 132)}
    with pytest.raises(ValueError):
        P.covering(p, "duration", 1, "mean")
    assert P.covering(e, "duration", 1).count() == p.count()


# ---- phases


def test_phase_ranges(spark):
    v = [0.0, 3.0, 4.0, -4.0, 10.0, -10.0, math.pi, -math.pi]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    for r in df.select("v", C.wrap("v").alias("w"), C.to_positive("v").alias("p")).collect():
        assert -math.pi <= r.w < math.pi and abs(math.remainder(r.w - r.v, 2 * math.pi)) < 1e-9
        assert 0 <= r.p < 2 * math.pi


def test_interferogram_of_a_constant_shift(spark):
    rows = [(day(d), float(y), float(x), math.cos(0.3 * d), math.sin(0.3 * d)) for d in (0, 1) for y in range(4) for x in range(4)]
    s = spark.createDataFrame(rows, "date date, y double, x double, re double, im double")
    out = phase.single_look(P.normalise([(day(0), day(1))], spark), s).collect()
    assert len(out) == 16 and all(abs(r.phase + 0.3) < 1e-9 and abs(r.correlation - 1) < 1e-9 for r in out)
    multi = phase.multi_look(P.normalise([(day(0), day(1))], spark), s, (2, 2)).collect()
    assert len(multi) == 4 and all(abs(r.phase + 0.3) < 1e-9 for r in multi)


def test_goldstein_keeps_a_pure_tone(spark):
    y, x = np.mgrid[0:24, 0:24]
    z = np.exp(1j * 2 * np.pi * x / 8)
    rows = [("p", day(0), day(1), float(a), float(b), float(z[a, b].real), float(z[a, b].imag), 0.5) for a, b in zip(y.ravel().tolist(), x.ravel().tolist(), strict=True)]
    d = spark.createDataFrame(rows, "pair string, ref date, rep date, y double, x double, re double, im double, correlation double")
    whole = {(r.y, r.x): (r.re, r.im) for r in phase.goldstein(d, 8, tile=64).collect()}
    tiled = {(r.y, r.x): (r.re, r.im) for r in phase.goldstein(d, 8, tile=8).collect()}
    for k, (re, im) in whole.items():
        if re is None or tiled[k][0] is None:
            assert re is None and tiled[k][0] is None
            continue
        assert abs(re - tiled[k][0]) < 1e-6 and abs(im - tiled[k][1]) < 1e-6
        if 8 <= k[0] < 12 and 8 <= k[1] < 12:
            assert abs(math.remainder(math.atan2(im, re) - 2 * math.pi * k[1] / 8, 2 * math.pi)) < 1e-6


# ---- rasters


def test_gaussian_impulse_and_holes(spark):
    a = np.zeros((21, 21))
    a[10, 10] = 1
    got = dense(raster.gaussian(grid(spark, a), ["v"], (1.5, 1.0), tile=8), a.shape)
    ky, kx = geometry.gaussian_1d(1.5), geometry.gaussian_1d(1.0)
    want = np.zeros_like(a)
    want[10 - len(ky) // 2 : 11 + len(ky) // 2, 10 - len(kx) // 2 : 11 + len(kx) // 2] = np.outer(ky, kx)
    assert np.allclose(got, want, atol=1e-12)
    b = np.full((9, 9), 4.0)
    b[4, 4] = np.nan
    assert np.allclose(dense(raster.gaussian(grid(spark, b), ["v"], (1, 1)), b.shape), 4)


def test_gaussian_tiles_do_not_show(spark):
    a = np.random.default_rng(0).normal(size=(30, 26))
    a[3:5, 7:9] = np.nan
    g = grid(spark, a)
    assert np.allclose(dense(raster.gaussian(g, ["v"], (2, 1), tile=12), a.shape), dense(raster.gaussian(g, ["v"], (2, 1), tile=256), a.shape))
    assert np.allclose(dense(raster.gaussian(g, ["v"], (2, 1), tile=256), a.shape), raster.smoothed(a, None, (2, 1)), equal_nan=True)


def test_masks_by_hand(spark):
    m = np.zeros((7, 7))
    m[1:6, 1:6] = 1
    m[0, 0] = 1
    er = dense(raster.erosion(grid(spark, m, "mask")).withColumn("v", F.col("mask").cast("double")), m.shape)
    want = np.zeros((7, 7))
    want[2:5, 2:5] = 1
    assert (er == want).all()
    op = dense(raster.opening(grid(spark, m, "mask")).withColumn("v", F.col("mask").cast("double")), m.shape)
    assert op[0, 0] == 0 and op[3, 1] == 1 and op[1, 1] == 0
    cl = dense(raster.closing(grid(spark, 1 - m, "mask")).withColumn("v", F.col("mask").cast("double")), m.shape)
    assert cl[3, 3] == 0


def test_labels(spark):
    m = np.zeros((8, 8))
    m[0:3, 0:3] = 1
    m[4:6, 4:6] = 1
    m[3, 3] = 1  # touches both by corners only
    labels = raster.label(grid(spark, m, "mask"))
    by = {(r.y, r.x): r.label for r in labels.collect()}
    assert len(set(by.values())) == 3 and by[3.0, 3.0] not in (by[2.0, 2.0], by[4.0, 4.0])
    assert raster.main_component(labels).count() == 9
    two = grid(spark, m, "mask").withColumn("pair", F.explode(F.array(F.lit("a"), F.lit("b"))))
    assert raster.main_component(raster.label(two, keys=["pair"]), ["pair"]).count() == 18


def test_coarsen_and_fill(spark):
    a = np.arange(35.0).reshape(5, 7)
    got = raster.coarsen(grid(spark, a), (2, 3), ["v"]).collect()
    assert {(r.y, r.x): r.v for r in got} == {(0.5 + 2 * i, 1.0 + 3 * j): a[2 * i : 2 * i + 2, 3 * j : 3 * j + 3].mean() for i in range(2) for j in range(2)}
    assert raster.coarsen(grid(spark, a), (2, 3), ["v"], pad=True).count() == 9
    a[2, 3] = np.nan
    assert dense(raster.fill_nearest(grid(spark, a), "v", 2), a.shape)[2, 3] == a[1, 3]
    assert dense(raster.fill_nearest(grid(spark, a), "v", 0), a.shape)[2, 3] != dense(raster.fill_nearest(grid(spark, a), "v", 0), a.shape)[2, 3]


def test_regrid_reproduces_planes(spark):
    y, x = np.mgrid[0:10, 0:10]
    g = grid(spark, 2.0 * y + 3.0 * x)
    target = spark.createDataFrame([(3.25, 4.5), (5.0, 5.0), (4.75, 6.125)], "y double, x double")
    for method, tol in (("linear", 1e-9), ("cubic", 0.2), ("lanczos", 0.2)):
        for r in raster.regrid(g, "v", Grid(0, 1, 10, 0, 1, 10), target, method).collect():
            assert abs(r.v - (2 * r.y + 3 * r.x)) < tol, method


def test_slope_of_a_ramp(spark):
    y, x = np.mgrid[0:5, 0:6]
    got = dense(raster.slope_degrees(grid(spark, 3.0 * x + 4.0 * y, "topo"), "topo"), (5, 6), "slope")
    assert np.allclose(got, math.degrees(math.atan(5)))


# ---- regression and inversion


def cube(spark, f, n=6, dates=10, step=12):
    rows = [(day(step * d), float(y), float(x), float(f(step * d, y, x))) for d in range(dates) for y in range(n) for x in range(n)]
    return spark.createDataFrame(rows, "date date, y double, x double, displacement double")


def test_velocity_and_trend(spark):
    c = cube(spark, lambda t, y, x: y + 0.01 * x * t)
    for r in regression.velocity(c).collect():
        assert abs(r.velocity - 3.6525 * r.x) < 1e-6
    q = cube(spark, lambda t, y, x: 1 + 0.1 * t + 0.001 * t * t)
    for r in regression.trend(q, "displacement", 2).join(q, ["date", "y", "x"]).limit(50).collect():
        assert abs(r.trend - r.displacement) < 1e-2


def test_regression_of_a_plane(spark):
    rows = [("p", float(y), float(x), 1 + 2.0 * y - 3.0 * x if (y + x) % 5 else None) for y in range(12) for x in range(12)]
    d = spark.createDataFrame(rows, "pair string, y double, x double, phase double")
    for r in regression.regression_linear(d, "phase", ["y", "x"], ["pair"], least=50).collect():
        assert abs(r.model - (1 + 2 * r.y - 3 * r.x)) < 1e-9
    assert regression.regression_linear(d, "phase", ["y", "x"], ["pair"], least=1000).filter("model IS NOT NULL").count() == 0
    lazy = regression.regression_sgd(d, "phase", ["y", "x"], ["pair"], least=50, alpha=1e-6).collect()
    assert all(abs(r.model - (1 + 2 * r.y - 3 * r.x)) < 1e-2 for r in lazy)


def test_robust_plane_ignores_outliers(spark):
    r = np.random.default_rng(0)
    rows = [(float(x), float(y), float(5 + 0.1 * x - 0.2 * y + r.normal(0, 0.01) + (50 if i % 17 == 0 else 0))) for i, (x, y) in enumerate(r.uniform(0, 100, (300, 2)))]
    coef, (x0, x1, y0, y1) = regression.robust_plane(spark.createDataFrame(rows, "x double, y double, z double"))
    assert abs(coef[1] * 2 / (x1 - x0) - 0.1) < 0.02 and abs(coef[2] * 2 / (y1 - y0) + 0.2) < 0.02


def test_incomplete_beta():
    assert abs(regression.incomplete_beta(2, 3, 0.4) - 0.5248) < 1e-4
    assert abs(regression.incomplete_beta(50, 50, 0.5) - 0.5) < 1e-9


def pair_values(spark, truth, ring, noise=None):
    rows = [(day(a), day(b), 0.0, float(x), truth(b, x) - truth(a, x) if noise is None else noise(a, b, x, truth)) for a, b in ring for x in range(3)]
    return spark.createDataFrame(rows, "ref date, rep date, y double, x double, phase double")


def test_lstsq_recovers_histories(spark):
    ring = [(0, 12), (12, 24), (24, 36), (0, 24), (12, 36), (0, 36)]
    truth = lambda t, x: (x + 1) * t / 10 + math.sin(t)
    d = pair_values(spark, truth, ring)
    for r in inversion.lstsq(d).collect():
        t = (r.date - START).days
        assert abs(r.displacement - (truth(t, r.x) - truth(0, r.x))) < 1e-4
    gone = d.withColumn("phase", F.when((F.col("x") != 1) & ~((F.col("ref") == day(0)) & (F.col("rep") == day(36))), F.col("phase")))
    got = inversion.lstsq(gone).collect()
    assert all(r.displacement is None for r in got if r.x == 1)
    assert all(abs(r.displacement - (truth((r.date - START).days, r.x) - truth(0, r.x))) < 1e-4 for r in got if r.x != 1)
    chain = {(r.date, r.x): r.displacement for r in inversion.chain_sums(pair_values(spark, truth, ring[:3])).collect()}
    assert abs(chain[day(36), 2.0] - (truth(36, 2) - truth(0, 2))) < 1e-9


def test_unwrap1d_recovers_sums(spark):
    ring = [(0, 12), (12, 24), (24, 36), (0, 24), (12, 36), (0, 36)]
    truth = lambda t, x: 0.11 * t
    wrapped = lambda a, b, x, f: (f(b, x) - f(a, x) + math.pi) % (2 * math.pi) - math.pi
    for r in inversion.unwrap1d(pair_values(spark, truth, ring, wrapped)).collect():
        assert abs(r.phase - 0.11 * (r.rep - r.ref).days) < 1e-6


def unwrapped_by_hand(ends, v, tolerance=math.pi / 2):
    """Pairs (date numbers) and values (None: missing) of one pixel: each pair by its definition."""
    have = {e: x for e, x in zip(ends, v, strict=True) if x is not None}
    out, sure = dict(have), set()
    for (a, b), x in have.items():
        steps = [(k, k + 1) for k in range(a, b)]
        if b - a > 1 and all(s in have for s in steps):
            total = sum(have[s] for s in steps)
            y = min((x + 2 * math.pi * k for k in range(-20, 21)), key=lambda z: abs(z - total))  # noqa: B023
            if abs(y - total) < tolerance:
                out[a, b] = y
                sure |= {(a, b), *steps}
    return [out.get(e) if e in sure or not sure else None for e in ends]


def test_unwrap_matches_its_definition():
    r = np.random.default_rng(8)
    for n in (3, 5, 8):
        ends = [(a, b) for a in range(n) for b in range(a + 1, n) if r.random() < 0.75]
        ends += [(k, k + 1) for k in range(n - 1) if (k, k + 1) not in ends]
        m = np.array([[1.0 if a < d <= b else 0.0 for d in range(n)] for a, b in ends])
        path = r.normal(0, 2, (400, n))
        v = np.stack([path[:, b] - path[:, a] for a, b in ends], 1) + r.normal(0, 0.7, (400, len(ends)))
        v = np.where(r.random(v.shape) < 0.15, np.nan, (v + math.pi) % (2 * math.pi) - math.pi)
        v[:2] = np.nan
        got = inversion.unwrap(v, m)
        for i in range(400):
            want = unwrapped_by_hand(ends, [None if np.isnan(x) else x for x in v[i]])
            assert np.allclose(got[i], [np.nan if x is None else x for x in want], equal_nan=True)
        order = r.permutation(len(ends))  # the order of pairs doesn't matter
        assert np.allclose(inversion.unwrap(v[:, order], m[order]), got[:, order], equal_nan=True)


def test_least_squares_rows_match_each_solved_alone():
    r = np.random.default_rng(9)
    ends = [(a, b) for a in range(6) for b in range(a + 1, 6) if b - a < 4]
    m = np.array([[1.0 if a < d <= b else 0.0 for d in range(6)] for a, b in ends])
    v = np.where(r.random((300, len(ends))) < 0.3, np.nan, r.normal(0, 3, (300, len(ends))))
    v[0] = np.nan
    w = r.uniform(0.05, 1, v.shape)
    for weight in (None, w):
        got = inversion.solve(v, weight, m, cumulative=False)
        assert np.isnan(got[0]).all()
        for i in range(1, 300):
            there = ~np.isnan(v[i])
            q = np.ones(there.sum()) if weight is None else np.sqrt((w[i, there] * (1 - 1e-6)) ** 2 / (1 - (w[i, there] * (1 - 1e-6)) ** 2))
            want = np.linalg.lstsq(m[there] * q[:, None], v[i, there] * q, rcond=None)[0]
            assert np.allclose(got[i], want, atol=1e-6)


def test_residuals_of_a_perfect_solution(spark):
    ring = [(0, 12), (12, 24), (0, 24)]
    truth = lambda t, x: 0.2 * t
    d = pair_values(spark, truth, ring)
    s = spark.createDataFrame([(day(t), 0.0, float(x), truth(t, x)) for t in (0, 12, 24) for x in range(3)], "date date, y double, x double, displacement double")
    assert all(r.rmse < 1e-6 for r in stats.residual_rmse(d, s).collect())


def test_stl_parts(spark):
    t = np.arange(210)
    y = 0.05 * t + 2 * np.sin(2 * np.pi * t / 7)
    trend, season, rest = stl.Stl(210, 7)(y[None])
    assert np.abs(trend[0, 20:-20] - 0.05 * t[20:-20]).max() < 0.1 and np.abs(season[0] - 2 * np.sin(2 * np.pi * t / 7)).max() < 0.25
    assert np.allclose(trend + season + rest, y)
    z = y + np.random.default_rng(0).normal(0, 0.1, 210)
    z[100] += 50
    robust = stl.Stl(210, 7, robust=True)(z[None])
    assert np.abs(robust[0][0, 30:-30] - 0.05 * t[30:-30]).max() < 0.2
    rows = [(day(int(d)), 0.0, 0.0, float(v)) for d, v in zip(t, y, strict=True)] + [(day(int(d)), 0.0, 1.0, None if d == 5 else 1.0) for d in t]
    got = stl.stl(spark.createDataFrame(rows, "date date, y double, x double, displacement double"), freq="D", period=7)
    assert got.filter("x = 1 AND trend IS NOT NULL").count() == 0 and got.filter("x = 0 AND trend IS NOT NULL").count() == 210


def test_weekly_dates():
    assert stl.weekly(dt.date(2024, 1, 1), dt.date(2024, 1, 21)) == [dt.date(2024, 1, 7), dt.date(2024, 1, 14), dt.date(2024, 1, 21)]


def test_unwrap2d_ramp_over_tiles(spark):
    y, x = np.mgrid[0:20, 0:20]
    true = 0.7 * x + 0.4 * y
    w = (true + np.pi) % (2 * np.pi) - np.pi
    rows = [("p", day(0), day(1), float(a), float(b), None if (a, b) == (3, 3) else float(w[a, b])) for a in range(20) for b in range(20)]
    d = spark.createDataFrame(rows, "pair string, ref date, rep date, y double, x double, phase double")
    got = dense(unwrap2d.unwrap2d(d, weight=None, config=unwrap2d.Config(tile=8)), (20, 20), "phase")
    off = got - true
    assert np.isnan(got[3, 3]) and np.nanmax(off) - np.nanmin(off) < 1e-6
    assert unwrap2d.Config(more={"X": True}).text() == "DEFOMAX_CYCLE 0.0\nX TRUE\n"


# ---- statistics and parameters


def test_scatterers(spark):
    rows = [(day(d), float(y), 0.0, (d + 1) * (y + 1.0)) for d in range(4) for y in range(3)]
    got = stats.scatterer_stats(spark.createDataFrame(rows, "date date, y double, x double, intensity double")).collect()
    assert all(abs(r.deviation) < 1e-9 and abs(r.average - 2.5 * (r.y + 1)) < 1e-9 for r in got)


def test_parameter_maps(spark):
    df = params.from_lines(spark, ["PRF = 486.5", "name = a = b", "PRF = 500", "bad line"])
    assert df.first().params == {"PRF": "500", "name": "a = b"}
    m = F.col("params")
    r = df.select(params.number(m, "PRF").alias("prf"), params.with_values(m, x=1, PRF=2).alias("w"), params.shifted(m, 1.5).alias("s"), params.to_text(m).alias("t")).first()
    assert r.prf == 500 and r.w == {"PRF": "2", "x": "1", "name": "a = b"} and r.s["PRF"] == "501.5" and r.t == "PRF = 500\nname = a = b"
    a, b = params.explode(df), params.explode(df.select(params.with_values(m, PRF="500.0", y=3).alias("params")))
    assert [tuple(x) for x in params.difference(a, b).collect()] == [("y", "3")]


def test_geometry():
    p = {"earth_radius": 6371000.0, "SC_height": 693000.0, "SC_vel": 7500.0, "PRF": 486.486, "rng_samp_rate": 64345238.0, "near_range": 800000.0, "num_rng_bins": 20000}
    az, rg = geometry.pixel_spacing(p)
    assert 13 < az < 16 and 3 < rg < 5
    assert geometry.coarsen_factors((1, 4), (14, 4)) == (1, 4) and geometry.coarsen_factors((60.0, 60.0), (14, 4)) == (4, 16)
    with pytest.raises(TypeError):
        geometry.coarsen_factors((1, 4.0), (14, 4))
    up, side = geometry.baseline_components([0, 0, 100], [7e6, 0, 0], [7e6, 1, 0], False, False)
    assert abs(up) < 1e-9 and abs(side - 100) < 1e-9
    assert abs(geometry.ellipsoid_height(6378137.0 + 10, 0.0, 0.0)[0] - 10) < 1e-6


def test_exports(spark):
    d = spark.createDataFrame([("a", 1.0, 2.0, 3.14159), ("b", 1.0, 2.0, float("nan")), ("b", 1.5, 2.0, 2.0)], "k string, lat double, lon double, v double")
    assert export.csv_rows(d, "v", "k").count() == 2
    assert sorted(r.value for r in export.geojson_lines(d, "v", "k", keys=["a", "b"]).collect())[0].startswith('{"type":"Feature","properties":{')
    assert export.reference_system(["lat", "lon"]) == 4326
    with pytest.raises(ValueError):
        export.reference_system(["a"])


def test_parameter_difference_by_key(spark):
    cols = "k long, name string, value string"
    a = spark.createDataFrame([(1, "x", "1"), (1, "y", "2"), (2, "x", "1"), (2, "y", "3")], cols)
    b = spark.createDataFrame([(1, "x", "1.0"), (1, "y", "2"), (2, "x", "2"), (2, "y", "3")], cols)
    assert sorted(map(tuple, params.difference(a, b, "k").collect())) == [(2, "x", "1"), (2, "x", "2")]


def test_polygon_clip(spark):
    r = np.random.default_rng(3)
    pts = r.uniform(-2, 12, (2000, 2))
    ring = [(0, 0), (10, 1), (9, 9), (5, 4), (1, 8), (0, 0)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pts], "x double, y double")

    def inside(x, y):
        angle = 0.0
        for (xa, ya), (xb, yb) in zip(ring, ring[1:], strict=False):
            a, b = math.atan2(ya - y, xa - x), math.atan2(yb - y, xb - x)
            angle += (b - a + math.pi) % (2 * math.pi) - math.pi
        return abs(angle) > 1

    def near(x, y, d):
        out = []
        for (xa, ya), (xb, yb) in zip(ring, ring[1:], strict=False):
            t = min(1, max(0, ((x - xa) * (xb - xa) + (y - ya) * (yb - ya)) / ((xb - xa) ** 2 + (yb - ya) ** 2)))
            out.append(math.hypot(x - xa - t * (xb - xa), y - ya - t * (yb - ya)))
        return min(out) <= d

    for d in (0.0, 0.7):
        got = {(p.x, p.y) for p in stats.clip_polygon(df, ring, d).collect()}
        assert got == {(float(a), float(b)) for a, b in pts if inside(a, b) or (d and near(a, b, d))}


@pytest.mark.parametrize("bracket", [1_000_000, 20])
def test_quantiles_of_a_whole_column(spark, monkeypatch, bracket):
    """Small brackets take the rounds of histograms that large tables need; ties fill whole brackets."""
    monkeypatch.setattr(stats, "MOST_BRACKET", bracket)
    r = np.random.default_rng(4)
    for values in (r.normal(0, 1, 3000), np.round(r.exponential(1, 2000), 1), np.full(500, 2.5), np.concatenate([np.full(900, 1e9), r.normal(0, 1e-9, 500)]), np.array([7.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
        at = [0.0, 0.01, 0.5, 0.77, 1.0]
        got = stats.quantiles(df, "v", at).first()
        assert np.allclose(list(got), np.quantile(values, at), rtol=1e-12, atol=1e-18)
    assert tuple(stats.quantiles(df.filter("v > 100"), "v", [0.5]).first()) == (None,)


def test_report_of_a_place(spark):
    from fringework.operators import report

    steps = list(range(0, 40))
    rows = [(day(a), day(b), float(y), float(x), (b - a) * 0.02 * (x + 1) + 0.3 * (math.sin(2 * math.pi * b / 7) - math.sin(2 * math.pi * a / 7)), 0.8) for a in steps for b in (a + 1, a + 2) if b < 40 for y in (0, 1) for x in (0, 1)]
    data = spark.createDataFrame(rows, "ref date, rep date, y double, x double, phase double, correlation double")
    got = report.displacement_report(data, 0.9, 1.2, wavelength=0.0556, weight="correlation", freq="D", period=7).orderBy("date").collect()
    scale = -0.0556 / (4 * math.pi) * 1000
    assert len(got) == 40 and {(r.y, r.x) for r in got} == {(1.0, 1.0)}
    truth = scale * np.array([0.04 * k + 0.3 * math.sin(2 * math.pi * k / 7) for k in steps])
    slope, start = np.polyfit(steps, truth, 1)
    for k, r in enumerate(got):
        assert abs(r.displacement - truth[k]) < 0.02
        assert abs(r.velocity - slope * 365.25) < 0.02 and abs(r.line - start - slope * k) < 0.02 and r.rmse < 0.01
        assert abs(r.trend + r.seasonal - r.displacement) < 0.02 and abs(r.trend - scale * 0.04 * k) < 0.05
