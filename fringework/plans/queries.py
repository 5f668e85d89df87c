"""Registered queries of the interferometric operators over the driver's tables, with their SQL where SQL can say it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fringework.functions import columns as C
from fringework.functions import geometry
from fringework.operators import export, geocode, inversion, params, phase, raster, regression, stats, stl, unwrap2d
from fringework.operators import pairs as P
from fringework.operators.raster import Grid
from fringework.plans import samples as S
from fringework.plans.samples import BASE, NAME, PI, TAU, wrapped_sql
from fringework.sources import catalog, rasters
from fringework.shared import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
GRID = Grid(0.0, 1.0, 12, 0.0, 1.0, 10)
PAIR_COLUMNS = "ref, rep, pair, ref_baseline, rep_baseline, baseline, duration, rel"


def query(sql: str | None = None, base: bool = True) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (BASE + ", " if base and sql.lstrip()[:1] == "," else BASE if base else "") + sql.lstrip().removeprefix(",")
        return f

    return add


HAIR = 1.37e-9  # samples are 64ths, whose halves at the last digit engines round either way; this settles them alike


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n) + HAIR, digits) for n in names})


def r(x: str, digits: int = 6) -> str:
    """Rounding in SQL without a negative zero."""
    return f"(round(({x}) + {HAIR!r}, {digits}) + 0e0)"


# ---- networks


@query(f"SELECT {PAIR_COLUMNS} FROM pairs")
def sbas_pairs(spark, sf):
    return S.pairs(spark, sf)


@query(f"""SELECT rep AS ref, ref AS rep, strftime(rep, '%Y-%m-%d') || ' ' || strftime(ref, '%Y-%m-%d') AS pair, rep_baseline AS ref_baseline, ref_baseline AS rep_baseline,
  round(ref_baseline - rep_baseline, 2) AS baseline, CAST(-duration AS INTEGER) AS duration, rel FROM pairs""")
def sbas_pairs_inverted(spark, sf):
    return P.make_pairs(S.scenes(spark, sf), S.DAYS, S.METERS, invert=True)


@query(f", w AS (SELECT date AS ref, lead(date) OVER (ORDER BY date) AS rep FROM scenes) SELECT ref, rep, {NAME} AS pair FROM w WHERE rep IS NOT NULL")
def consecutive_pairs(spark, sf):
    return P.consecutive_pairs(S.scenes(spark, sf))


@query("SELECT date FROM dates")
def pair_dates(spark, sf):
    return P.dates_of(P.normalise(S.pairs(spark, sf).select("pair")))


@query("SELECT ref, rep, pair FROM pairs WHERE day(ref) % 7 <> 0 AND day(rep) % 7 <> 0")
def pairs_drop_dates(spark, sf):
    return P.drop_dates(S.pairs(spark, sf), S.scenes(spark, sf).filter(F.dayofmonth("date") % 7 == 0)).select("ref", "rep", "pair")


def _pruning(steps: list[int]) -> str:
    parts, last = [], "pairs"
    for i, k in enumerate(steps):
        parts.append(f"d{i} AS (SELECT date FROM (SELECT ref AS date FROM {last} UNION ALL SELECT rep FROM {last}) GROUP BY date HAVING count(*) >= {k}), p{i} AS (SELECT * FROM {last} WHERE ref IN (SELECT date FROM d{i}) AND rep IN (SELECT date FROM d{i}))")
        last = f"p{i}"
    return ", " + ", ".join(parts) + f" SELECT ref, rep, pair FROM {last}"


@query(_pruning([1, 2, 3, 4, 5, 6, 7, 8]))
def pairs_limit_degree(spark, sf):
    return P.limit_degree(S.pairs(spark, sf), 8, 1).select("ref", "rep", "pair")


EXTENDED = f"""m AS (SELECT a.ref, b.rep, a.rep AS rel, a.ref_baseline, b.rep_baseline FROM pairs a JOIN pairs b ON a.rep = b.ref ANTI JOIN pairs p ON p.ref = a.ref AND p.rep = b.rep),
n AS (SELECT *, row_number() OVER (PARTITION BY ref, rep ORDER BY rel) AS k FROM m),
extended AS (SELECT {PAIR_COLUMNS} FROM pairs UNION ALL SELECT ref, rep, {NAME}, ref_baseline, rep_baseline, round(rep_baseline - ref_baseline, 2), CAST(date_diff('day', ref, rep) AS INTEGER), rel FROM n WHERE k = 1)"""
EXTENDED = EXTENDED.replace("m AS (SELECT a.ref, b.rep, a.rep AS rel, a.ref_baseline, b.rep_baseline FROM pairs a JOIN pairs b ON a.rep = b.ref ANTI JOIN pairs p ON p.ref = a.ref AND p.rep = b.rep)", "m AS (SELECT a.ref, b.rep, a.rep AS rel, a.ref_baseline, b.rep_baseline FROM pairs a JOIN pairs b ON a.rep = b.ref WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.ref = a.ref AND p.rep = b.rep))")


@query(f", {EXTENDED} SELECT {PAIR_COLUMNS} FROM extended")
def pairs_extend(spark, sf):
    return P.extend(S.pairs(spark, sf))


def _covering(column: str, order: str, n: int) -> str:
    return f""", days AS (SELECT *, unnest(generate_series(ref, rep, INTERVAL 1 DAY)) AS d FROM pairs),
k AS (SELECT ref, rep, pair, row_number() OVER (PARTITION BY d ORDER BY {column} {order}, ref, rep) AS n FROM days)
SELECT DISTINCT ref, rep, pair FROM k WHERE n <= {n}"""


@query(_covering("baseline", "ASC", 2))
def pairs_covering(spark, sf):
    return P.covering_deviation(S.pairs(spark, sf), 2, "baseline").select("ref", "rep", "pair")


@query(_covering("duration", "DESC", 1))
def pairs_covering_correlation(spark, sf):
    return P.covering_correlation(S.pairs(spark, sf), 1, "duration").select("ref", "rep", "pair")


CODE = "CASE WHEN date = ref THEN -1 WHEN date = rep THEN 1 WHEN date > ref AND date < rep THEN 0 END"


@query(f"SELECT pair, date, CAST({CODE} AS FLOAT) AS code FROM pairs, dates")
def pairs_matrix(spark, sf):
    return P.incidence(S.pairs(spark, sf)).select("pair", "date", "code")


@query("SELECT pair, date, CASE WHEN date > ref AND date <= rep THEN 1 ELSE 0 END AS code FROM pairs, dates")
def lstsq_matrix(spark, sf):
    return P.inversion_matrix(S.pairs(spark, sf)).select("pair", "date", "code")


@query(f"SELECT pair, date, coalesce({CODE}, 0) AS code FROM pairs, dates")
def lstsq_matrix_edge(spark, sf):
    return P.edge_matrix(S.pairs(spark, sf)).select("pair", "date", "code")


def _thin(df: DataFrame) -> DataFrame:
    """A network with dates that no pair covers: pairs of the even days only, and one long gap."""
    return df.filter((F.dayofmonth("ref") % 4 == 0) | (F.dayofmonth("rep") % 4 == 0)).filter("duration <= 2")


THIN = """thin AS (SELECT * FROM pairs WHERE (day(ref) % 4 = 0 OR day(rep) % 4 = 0) AND duration <= 2),
td AS (SELECT DISTINCT date FROM (SELECT ref AS date FROM thin UNION ALL SELECT rep FROM thin)),
tw AS (SELECT lag(date) OVER (ORDER BY date) AS ref, date AS rep FROM td),
gaps AS (SELECT ref, rep FROM tw WHERE ref IS NOT NULL AND NOT EXISTS (SELECT 1 FROM thin p WHERE tw.rep > p.ref AND tw.rep <= p.rep))"""


@query(f", {THIN} SELECT ref, rep, {NAME} AS pair FROM gaps")
def pairs_uncovered(spark, sf):
    return P.uncovered(_thin(S.pairs(spark, sf)))


def _thin_data(spark, sf):
    return S.pair_data(spark, sf).join(F.broadcast(_thin(S.pairs(spark, sf)).select("ref", "rep")), ["ref", "rep"], "left_semi")


def _filled(value: str, constant: str) -> str:
    return f""", {THIN}, own AS (SELECT d.* FROM data d JOIN thin t ON t.ref = d.ref AND t.rep = d.rep),
f AS (SELECT ref, rep, y, x, {value} FROM own UNION ALL SELECT g.ref, g.rep, c.y, c.x, {constant} FROM (SELECT DISTINCT y, x FROM own) c, gaps g)
SELECT {NAME} AS pair, y, x, {r(value)} AS {value} FROM f"""


@query(_filled("phase", "0e0"))
def interferogram_fill(spark, sf):
    return rounded(P.fill(_thin_data(spark, sf), "phase", 0.0).select("pair", "y", "x", "phase"), "phase")


@query(_filled("correlation", "1e0"))
def correlation_fill(spark, sf):
    return rounded(P.fill(_thin_data(spark, sf), "correlation", 1.0).select("pair", "y", "x", "correlation"), "correlation")


def _extended_data(value: str, new: str) -> str:
    return f""", {EXTENDED}, j AS (SELECT e.ref, e.rep, a.y, a.x, {new} AS {value} FROM extended e JOIN data a ON a.ref = e.ref AND a.rep = e.rel JOIN data b ON b.ref = e.rel AND b.rep = e.rep AND b.y = a.y AND b.x = a.x WHERE e.rel IS NOT NULL),
u AS (SELECT ref, rep, y, x, {value} FROM data UNION ALL SELECT * FROM j) SELECT {NAME} AS pair, y, x, {r(value, 4)} AS {value} FROM u"""


@query(_extended_data("correlation", "least(a.correlation, b.correlation)"))
def correlation_extend(spark, sf):
    return rounded(P.extend_correlation(S.pair_data(spark, sf), P.extend(S.pairs(spark, sf))).select("pair", "y", "x", "correlation"), "correlation", digits=4)


@query(_extended_data("phase", wrapped_sql("a.phase + b.phase")))
def interferogram_extend(spark, sf):
    return rounded(P.extend_phase(S.pair_data(spark, sf), P.extend(S.pairs(spark, sf))).select("pair", "y", "x", "phase"), "phase", digits=4)


@query(", b0 AS (SELECT bperp FROM scenes WHERE date = DATE '2024-01-05') SELECT date, round(bperp * 0.5 - (SELECT bperp * 0.5 FROM b0), 1) + 0e0 AS BPL, round(bperp - (SELECT bperp FROM b0), 1) + 0e0 AS BPR FROM scenes")
def baseline_table(spark, sf):
    return P.baseline_table(S.scenes(spark, sf).withColumn("bpara", F.col("bperp") * 0.5), "2024-01-05")


@query("SELECT DISTINCT date, value FROM (SELECT ref AS date, ref_baseline AS value FROM pairs UNION ALL SELECT rep, rep_baseline FROM pairs)")
def baseline_points(spark, sf):
    return P.date_points(S.pairs(spark, sf))


@query(f"SELECT date, {r('avg(value)')} AS value FROM (SELECT ref AS date, baseline AS value FROM pairs UNION ALL SELECT rep, baseline FROM pairs) GROUP BY date")
def baseline_attribute(spark, sf):
    return rounded(P.date_points(S.pairs(spark, sf), "baseline"), "value")


@query(f"SELECT CAST(floor((duration - 1e0) / 2) AS INTEGER) AS bin, count(*) AS n, sum(baseline) AS total, {r('avg(baseline)')} AS mean, CAST(floor((duration - 1e0) / 2) * 2 + 1 AS DOUBLE) AS start FROM pairs GROUP BY ALL")
def baseline_duration(spark, sf):
    return rounded(P.duration_bins(S.pairs(spark, sf), 2, "baseline"), "mean")


# ---- statistics

PS = """m AS (SELECT date, avg(v) AS a FROM stack GROUP BY date), t AS (SELECT avg(a) AS m FROM m),
ps AS (SELECT s.y, s.x, avg(t.m / nullif(m.a, 0) * s.v) AS average, stddev_pop(t.m / nullif(m.a, 0) * s.v) AS deviation FROM stack s JOIN m ON m.date = s.date, t GROUP BY s.y, s.x)"""


@query(f", {PS} SELECT y, x, {r('average')} AS average, {r('deviation')} AS deviation FROM ps")
def compute_ps(spark, sf):
    return rounded(stats.scatterer_stats(S.stack(spark, sf), "v"), "average", "deviation")


@query(f", {PS} SELECT y, x, {r('CASE WHEN deviation > 1e-9 THEN average / (2 * deviation) END', 4)} AS psf FROM ps")
def psfunction(spark, sf):
    ps = stats.scatterer_stats(S.stack(spark, sf), "v").withColumn("deviation", F.when(F.col("deviation") > 1e-9, F.col("deviation")))
    return rounded(stats.scatterer_function(ps).select("y", "x", "psf"), "psf", digits=4)


@query("SELECT date, " + r("avg(v)") + " AS stack_average FROM stack GROUP BY date")
def date_means(spark, sf):
    return rounded(stats.date_means(S.stack(spark, sf), "v"), "stack_average")


HISTOGRAM = "h AS (SELECT CAST(CASE WHEN correlation = 1 THEN 9 ELSE floor(correlation / 0.1e0) END AS INTEGER) AS bin, count(*) AS n FROM data WHERE correlation BETWEEN 0 AND 1 GROUP BY 1), hh AS (SELECT CAST(b.k AS INTEGER) AS bin, coalesce(h.n, 0) AS n FROM range(10) b(k) LEFT JOIN h ON h.bin = b.k)"


@query(f", {HISTOGRAM} SELECT bin, n FROM hh")
def histogram(spark, sf):
    return stats.histogram(S.pair_data(spark, sf), "correlation", 10, 0.0, 1.0)


@query(f", {HISTOGRAM} SELECT bin, n, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS total FROM hh")
def cumulative_histogram(spark, sf):
    return stats.cumulative_histogram(S.pair_data(spark, sf), "correlation", 10, 0.0, 1.0)


@query(f"SELECT {r('avg(correlation)')} AS mean, {r('median(correlation)')} AS median FROM data")
def correlation_middle(spark, sf):
    return rounded(stats.middle(S.pair_data(spark, sf), "correlation"), "mean", "median")


@query(""", w AS (SELECT CAST((event_id % 10) AS INTEGER) AS y, CAST(user_id % 4 AS INTEGER) AS x, CAST(floor(event_id / 30) % 4 AS INTEGER) AS k, CAST(sum(floor(value * 64)) AS DOUBLE) AS v FROM events GROUP BY ALL),
full_ AS (SELECT y, x FROM w GROUP BY y, x HAVING count(*) = (SELECT count(DISTINCT k) FROM w))
SELECT a.k AS k1, b.k AS k2, CASE WHEN a.k <> b.k THEN round(corr(a.v, b.v), 2) + 0e0 END AS corr FROM w a JOIN w b ON a.y = b.y AND a.x = b.x JOIN full_ f ON f.y = a.y AND f.x = a.x GROUP BY a.k, b.k""")
def corrcoef(spark, sf):
    e = table(spark, sf, "events")
    w = e.groupBy((F.col("event_id") % 10).cast("int").alias("y"), (F.col("user_id") % 4).cast("int").alias("x"), (F.floor(F.col("event_id") / 30) % 4).cast("int").alias("k")).agg(F.sum(F.floor(F.col("value") * 64)).cast("double").alias("v"))
    return stats.correlations(w, "k", "v", mask_diagonal=True)


RESIDUAL = wrapped_sql("d.phase - (b.v * 0.04e0 - a.v * 0.04e0)")


@query(f""", e AS (SELECT d.y, d.x, d.correlation AS w, {RESIDUAL} AS e FROM data d JOIN stack a ON a.date = d.ref AND a.y = d.y AND a.x = d.x JOIN stack b ON b.date = d.rep AND b.y = d.y AND b.x = d.x), n AS (SELECT count(DISTINCT pair) AS n FROM data)
SELECT y, x, {r('sqrt(sum(e * e) / (SELECT n FROM n))')} AS rmse FROM e GROUP BY y, x""")
def rmse(spark, sf):
    solution = S.stack(spark, sf).select("date", "y", "x", (F.col("v") * 0.04).alias("displacement"))
    return rounded(stats.residual_rmse(S.pair_data(spark, sf), solution), "rmse")


@query(f""", e AS (SELECT d.y, d.x, d.correlation AS w, {RESIDUAL} AS e FROM data d JOIN stack a ON a.date = d.ref AND a.y = d.y AND a.x = d.x JOIN stack b ON b.date = d.rep AND b.y = d.y AND b.x = d.x), n AS (SELECT count(DISTINCT pair) AS n FROM data)
SELECT y, x, {r('sqrt(sum(w * e * e) / sum(w) / (SELECT n FROM n))')} AS rmse FROM e GROUP BY y, x""")
def rmse_weighted(spark, sf):
    solution = S.stack(spark, sf).select("date", "y", "x", (F.col("v") * 0.04).alias("displacement"))
    return rounded(stats.residual_rmse(S.pair_data(spark, sf), solution, weight="correlation"), "rmse")


@query(f"SELECT pair, {r('avg(correlation)')} AS correlation FROM data GROUP BY pair")
def correlation_by_pair(spark, sf):
    return rounded(stats.mean_over(S.pair_data(spark, sf), ["pair"], "correlation"), "correlation")


@query(f"SELECT y, x, {r('avg(correlation)')} AS correlation FROM data GROUP BY y, x")
def correlation_stack(spark, sf):
    return rounded(stats.mean_over(S.pair_data(spark, sf), ["y", "x"], "correlation"), "correlation")


@query("SELECT y, min(v) AS low, max(v) AS high FROM total GROUP BY y")
def limits_by_row(spark, sf):
    return stats.by_axis(S.total(spark, sf), "y", "v")


@query("SELECT min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM stack")
def bounds(spark, sf):
    return stats.bounds(S.stack(spark, sf))


@query(f"SELECT {r('quantile_cont(v, 0.01)')} AS q0, {r('quantile_cont(v, 0.99)')} AS q1 FROM stack")
def plot_limits(spark, sf):
    return rounded(stats.quantiles(S.stack(spark, sf), "v", [0.01, 0.99]), "q0", "q1")


@query("""SELECT CAST(floor(y / 5) * 5 + 2 AS DOUBLE) AS y, CAST(floor(x / 4) * 4 + 1.5 AS DOUBLE) AS x, """ + r("avg(v)") + """ AS v FROM total WHERE y < 10 AND x < 8 GROUP BY ALL""")
def coarsen(spark, sf):
    return rounded(raster.decimator((5, 4))(S.total(spark, sf), ["v"]), "v")


@query("""SELECT CAST((floor(y / 5) * 5 + least(floor(y / 5) * 5 + 4, 11)) / 2 AS DOUBLE) AS y, CAST((floor(x / 4) * 4 + least(floor(x / 4) * 4 + 3, 9)) / 2 AS DOUBLE) AS x, max(v) AS v FROM total GROUP BY ALL""")
def coarsen_pad(spark, sf):
    return raster.coarsen(S.total(spark, sf), (5, 4), ["v"], "max", pad=True, grid=GRID)


@query("SELECT date, y, x, v FROM stack WHERE y BETWEEN 2 AND 9 AND x BETWEEN 3 AND 7")
def crop_missing(spark, sf):
    s = S.stack(spark, sf)
    inner = F.col("y").between(2, 9) & F.col("x").between(3, 7)
    return stats.crop_missing(s.withColumn("m", F.when(inner, F.col("v"))), "m").select("date", "y", "x", "v")


@query("SELECT pair, y, x, CASE WHEN correlation >= 0.3 THEN " + r("phase") + " END AS phase FROM data")
def threshold_mask(spark, sf):
    return rounded(stats.threshold(S.pair_data(spark, sf), "phase", 0.3, "correlation").select("pair", "y", "x", "phase"), "phase")


@query("SELECT date, y, x, v FROM stack WHERE y % 3 = 0 AND x % 2 = 0")
def stride(spark, sf):
    return raster.stride(S.stack(spark, sf), GRID, 3, 2)


# ---- masks and components

LOW = "(v - floor(v / 128e0) * 128e0) >= 40"
MASK = f"mask AS (SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CASE WHEN {LOW} THEN 1 ELSE 0 END AS m FROM total)"


def _mask(spark, sf) -> DataFrame:
    return S.total(spark, sf).select("y", "x", (C.floor_mod(F.col("v"), 128.0) >= 40).alias("mask"))


def _morph(source: str, out: str, erode: bool) -> str:
    test = "sum(b.m) = 5" if erode else "max(b.m) = 1"
    return f"{out} AS (SELECT a.y, a.x, CASE WHEN {test} THEN 1 ELSE 0 END AS m FROM {source} a JOIN {source} b ON abs(a.y - b.y) + abs(a.x - b.x) <= 1 GROUP BY a.y, a.x)"


def _said(name: str) -> str:
    return f" SELECT CAST(y AS DOUBLE) AS y, CAST(x AS DOUBLE) AS x, m = 1 AS mask FROM {name}"


@query(f", {MASK}, {_morph('mask', 'o', True)}{_said('o')}")
def binary_erosion(spark, sf):
    return raster.erosion(_mask(spark, sf), grid=GRID)


@query(f", {MASK}, {_morph('mask', 'o', False)}{_said('o')}")
def binary_dilation(spark, sf):
    return raster.dilation(_mask(spark, sf), grid=GRID)


@query(f", {MASK}, {_morph('mask', 'e', True)}, {_morph('e', 'o', False)}{_said('o')}")
def binary_opening(spark, sf):
    return raster.opening(_mask(spark, sf), grid=GRID)


@query(f", {MASK}, {_morph('mask', 'e', False)}, {_morph('e', 'o', True)}{_said('o')}")
def binary_closing(spark, sf):
    return raster.closing(_mask(spark, sf), grid=GRID)


REACH = f"""{MASK}, c AS (SELECT y, x, y * 10 + x AS id FROM mask WHERE m = 1),
reach AS (SELECT id, id AS other FROM c UNION SELECT r.id, b.id FROM reach r JOIN c a ON a.id = r.other JOIN c b ON abs(a.y - b.y) + abs(a.x - b.x) = 1),
labels AS (SELECT c.y, c.x, min(r.other) AS label FROM c JOIN reach r ON r.id = c.id GROUP BY c.y, c.x)"""


@query(f", {REACH} SELECT CAST(y AS DOUBLE) AS y, CAST(x AS DOUBLE) AS x, CAST(label AS BIGINT) AS label FROM labels")
def label_components(spark, sf):
    return raster.label(_mask(spark, sf), grid=GRID)


@query(f", {REACH}, n AS (SELECT label, count(*) AS n FROM labels GROUP BY label ORDER BY n DESC, label LIMIT 1) SELECT CAST(y AS DOUBLE) AS y, CAST(x AS DOUBLE) AS x FROM labels WHERE label = (SELECT label FROM n)")
def conncomp_main(spark, sf):
    return raster.main_component(raster.label(_mask(spark, sf), grid=GRID)).select("y", "x")


# ---- regression


@query(f""", f AS (SELECT pair, count(*) AS n, avg(phase) AS p, avg(y) AS my, avg(x) AS mx, var_pop(y) AS vy, var_pop(x) AS vx, covar_pop(y, x) AS c, covar_pop(phase, y) AS cy, covar_pop(phase, x) AS cx FROM data GROUP BY pair),
k AS (SELECT *, vy * vx - c * c AS det FROM f)
SELECT d.pair, d.y, d.x, CASE WHEN k.n >= 20 AND k.det > 1e-9 THEN {r('k.p + (k.cy * k.vx - k.cx * k.c) / k.det * (d.y - k.my) + (k.cx * k.vy - k.cy * k.c) / k.det * (d.x - k.mx)', 5)} END AS model FROM data d JOIN k ON k.pair = d.pair""")
def regression_linear(spark, sf):
    out = regression.regression_linear(S.pair_data(spark, sf), "phase", ["y", "x"], ["pair"], least=20)
    return rounded(out.select("pair", "y", "x", "model"), "model", digits=5)


@query()
def regression_sgd(spark, sf):
    out = regression.regression_sgd(S.pair_data(spark, sf), "phase", ["y", "x"], ["pair"], least=20)
    return out.select("pair", "y", "x", "model")


@query(f""", k AS (SELECT pair, count(*) AS n, sum(correlation) AS w, sum(correlation * y) / sum(correlation) AS my, sum(correlation * x) / sum(correlation) AS mx, sum(correlation * phase) / sum(correlation) AS p FROM data GROUP BY pair),
c AS (SELECT d.pair, any_value(k.n) AS n, any_value(k.my) AS my, any_value(k.mx) AS mx, any_value(k.p) AS p, sum(correlation * (y - my) * (y - my)) AS yy, sum(correlation * (x - mx) * (x - mx)) AS xx, sum(correlation * (y - my) * (x - mx)) AS yx,
  sum(correlation * (y - my) * phase) AS yp, sum(correlation * (x - mx) * phase) AS xp FROM data d JOIN k ON k.pair = d.pair GROUP BY d.pair)
SELECT d.pair, d.y, d.x, CASE WHEN c.n >= 20 THEN {r('c.p + (c.yp * c.xx - c.xp * c.yx) / (c.yy * c.xx - c.yx * c.yx) * (d.y - c.my) + (c.xp * c.yy - c.yp * c.yx) / (c.yy * c.xx - c.yx * c.yx) * (d.x - c.mx)', 5)} END AS model FROM data d JOIN c ON c.pair = d.pair""")
def regression_weighted(spark, sf):
    out = regression.regression(S.pair_data(spark, sf), "phase", ["y", "x"], ["pair"], weight="correlation", least=20)
    return rounded(out.select("pair", "y", "x", "model"), "model", digits=5)


ROLES = "roles AS (SELECT ref AS date, y, x, phase AS v, CAST(date_diff('day', ref, rep) AS DOUBLE) AS t, correlation AS w FROM data UNION ALL SELECT rep, y, x, -phase, CAST(-date_diff('day', ref, rep) AS DOUBLE), correlation FROM data)"


def _role_model(value: str) -> str:
    return f""", {ROLES}, m AS (SELECT date, y, x, {value} AS m FROM roles GROUP BY date, y, x)
SELECT d.ref, d.rep, d.y, d.x, {r('a.m - b.m')} AS phase FROM data d JOIN m a ON a.date = d.ref AND a.y = d.y AND a.x = d.x JOIN m b ON b.date = d.rep AND b.y = d.y AND b.x = d.x"""


@query(_role_model("avg(v)"))
def regression_pairs(spark, sf):
    return rounded(regression.pair_polynomial(S.pair_data(spark, sf), "phase", 0), "phase")


@query(_role_model("CASE WHEN var_pop(t) > 0 THEN regr_slope(v, t) END"))
def regression_pairs_linear(spark, sf):
    return rounded(regression.pair_polynomial(S.pair_data(spark, sf), "phase", 1), "phase")


@query(_role_model("sum(w * v) / sum(w)"))
def turbulence(spark, sf):
    return rounded(regression.turbulence(S.pair_data(spark, sf), "phase", "correlation"), "phase")


DAY = "CAST(date_diff('day', DATE '1970-01-01', date) AS DOUBLE)"


@query(f"SELECT y, x, {r(f'CASE WHEN count(*) > 1 THEN regr_slope(v, {DAY}) * 365.25e0 END', 4)} AS velocity FROM stack GROUP BY y, x")
def velocity(spark, sf):
    return rounded(regression.velocity(S.stack(spark, sf), "v"), "velocity", digits=4)


@query(f", f AS (SELECT y, x, avg(v) AS mv, avg({DAY}) AS mt, CASE WHEN count(*) > 1 THEN regr_slope(v, {DAY}) END AS b FROM stack GROUP BY y, x) SELECT s.date, s.y, s.x, {r(f'f.mv + f.b * ({DAY} - f.mt)', 4)} AS trend FROM stack s JOIN f ON f.y = s.y AND f.x = s.x")
def trend(spark, sf):
    return rounded(regression.trend(S.stack(spark, sf), "v").select("date", "y", "x", "trend"), "trend", digits=4)


@query(f""", c AS (SELECT y, x, avg({DAY}) AS m FROM stack GROUP BY y, x), t AS (SELECT s.date, s.y, s.x, s.v, ({DAY} - m) / 10 AS t FROM stack s JOIN c ON c.y = s.y AND c.x = s.x),
f AS (SELECT y, x, count(*) AS s0, sum(t) AS s1, sum(t * t) AS s2, sum(t * t * t) AS s3, sum(t * t * t * t) AS s4, sum(v) AS b0, sum(v * t) AS b1, sum(v * t * t) AS b2 FROM t GROUP BY y, x),
g AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS det FROM f)
SELECT t.date, t.y, t.x, {r('CASE WHEN s0 < 3 THEN v ELSE ((b0 * (s2 * s4 - s3 * s3) - s1 * (b1 * s4 - s3 * b2) + s2 * (b1 * s3 - s2 * b2)) + (s0 * (b1 * s4 - b2 * s3) - b0 * (s1 * s4 - s3 * s2) + s2 * (s1 * b2 - b1 * s2)) * t + (s0 * (s2 * b2 - s3 * b1) - s1 * (s1 * b2 - b1 * s2) + b0 * (s1 * s3 - s2 * s2)) * t * t) / det END', 3)} AS trend
FROM t JOIN g ON g.y = t.y AND g.x = t.x""")
def trend_quadratic(spark, sf):
    return rounded(regression.trend(S.stack(spark, sf), "v", 2).select("date", "y", "x", "trend"), "trend", digits=3)


@query()
def robust_plane(spark, sf):
    coef, box = regression.robust_plane(S.total(spark, sf).select("x", "y", F.col("v").alias("z")))
    return spark.createDataFrame([(*coef, *box)], "c0 double, cx double, cy double, x0 double, x1 double, y0 double, y1 double")


# ---- inversion and series


@query()
def lstsq(spark, sf):
    return inversion.lstsq(S.pair_data(spark, sf), "phase", "correlation")


@query(f""", c AS (SELECT date AS ref, lead(date) OVER (ORDER BY date) AS rep FROM scenes), d AS (SELECT c.ref, c.rep, a.y, a.x, b.v - a.v AS v FROM c JOIN stack a ON a.date = c.ref JOIN stack b ON b.date = c.rep AND b.y = a.y AND b.x = a.x)
SELECT min(ref) AS date, y, x, 0e0 AS displacement FROM d GROUP BY y, x UNION ALL SELECT rep, y, x, sum(v) OVER (PARTITION BY y, x ORDER BY rep) FROM d""")
def chain_history(spark, sf):
    p = F.broadcast(P.consecutive_pairs(S.scenes(spark, sf)))
    s = S.stack(spark, sf)
    one = s.select(F.col("date").alias("ref"), "y", "x", F.col("v").alias("v1")).join(p, "ref")
    d = one.join(s.select(F.col("date").alias("rep"), "y", "x", F.col("v").alias("v2")), ["rep", "y", "x"]).select("ref", "rep", "y", "x", (F.col("v2") - F.col("v1")).alias("phase"))
    return inversion.chain_sums(d)


@query(""", c AS (SELECT date AS ref, lead(date) OVER (ORDER BY date) AS rep FROM scenes), d AS (SELECT c.rep AS date, a.y, a.x, b.v - a.v AS v FROM c JOIN stack a ON a.date = c.ref JOIN stack b ON b.date = c.rep AND b.y = a.y AND b.x = a.x),
p AS (SELECT DISTINCT y, x FROM d), g AS (SELECT s.date, p.y, p.x FROM scenes s, p)
SELECT g.date, g.y, g.x, CAST(coalesce(sum(d.v) OVER (PARTITION BY g.y, g.x ORDER BY g.date), 0) * 64 AS BIGINT) AS displacement_64ths FROM g LEFT JOIN d ON d.date = g.date AND d.y = g.y AND d.x = g.x""")
def lstsq_chain(spark, sf):
    """The solver on a chain of consecutive pairs, whose history is a running sum; a step that isn't observed adds nothing."""
    p = P.consecutive_pairs(S.scenes(spark, sf))
    s = S.stack(spark, sf)
    one = s.select(F.col("date").alias("ref"), "y", "x", F.col("v").alias("v1")).join(F.broadcast(p), "ref")
    d = one.join(s.select(F.col("date").alias("rep"), "y", "x", F.col("v").alias("v2")), ["rep", "y", "x"]).select("ref", "rep", "y", "x", (F.col("v2") - F.col("v1")).alias("phase"))
    out = inversion.lstsq(d, "phase", pairs=p)
    return out.select("date", "y", "x", F.round(F.col("displacement") * 64).cast("long").alias("displacement_64ths"))


@query(f""", nd AS (SELECT date, row_number() OVER (ORDER BY date) AS n FROM dates),
e AS (SELECT d.ref, d.rep, d.y, d.x, d.phase, a.n AS i, b.n AS j FROM data d JOIN nd a ON a.date = d.ref JOIN nd b ON b.date = d.rep),
t AS (SELECT e.ref, e.rep, e.y, e.x, e.phase, e.i, e.j, count(s.i) AS have, sum(s.phase) AS total FROM e LEFT JOIN e s ON s.j = s.i + 1 AND s.y = e.y AND s.x = e.x AND s.i >= e.i AND s.j <= e.j GROUP BY ALL),
u AS (SELECT *, CASE WHEN j > i + 1 AND have = j - i THEN phase + {TAU} * round((total - phase) / {TAU}) END AS v FROM t),
o AS (SELECT *, coalesce(abs(v - total) < {PI} / 2, FALSE) AS ok FROM u),
s AS (SELECT a.*, a.ok OR (a.j = a.i + 1 AND EXISTS (SELECT 1 FROM o b WHERE b.ok AND b.y = a.y AND b.x = a.x AND b.i <= a.i AND b.j >= a.j)) AS sure FROM o a),
w AS (SELECT *, bool_or(sure) OVER (PARTITION BY y, x) AS some FROM s), cells AS (SELECT DISTINCT y, x FROM data)
SELECT p.pair, p.ref, p.rep, c.y, c.x, CASE WHEN w.sure OR NOT w.some THEN {r('CASE WHEN w.ok THEN w.v ELSE w.phase END')} END AS phase
FROM pairs p CROSS JOIN cells c LEFT JOIN w ON w.ref = p.ref AND w.rep = p.rep AND w.y = c.y AND w.x = c.x""")
def unwrap1d(spark, sf):
    return rounded(inversion.unwrap1d(S.pair_data(spark, sf), "phase", "correlation", pairs=S.pairs(spark, sf)), "phase")


@query()
def seasonal_decomposition(spark, sf):
    return stl.stl(S.stack(spark, sf), "v", freq="D", period=7)


@query("SELECT CAST(unnest(generate_series(min(date) + CAST((7 - isodow(min(date))) % 7 AS INTEGER), max(date), INTERVAL 7 DAY)) AS DATE) AS date FROM scenes")
def regular_dates(spark, sf):
    return stl.regular_dates(S.scenes(spark, sf))


# ---- phases and interferograms


@query(f"SELECT date, y, x, {r(wrapped_sql('v'))} AS wrapped, {r(f'(v + {TAU}) - {TAU} * floor((v + {TAU}) / {TAU})')} AS positive FROM stack")
def phase_ranges(spark, sf):
    return rounded(S.stack(spark, sf).select("date", "y", "x", C.wrap("v").alias("wrapped"), C.to_positive("v").alias("positive")), "wrapped", "positive")


DIFF = "diff AS (SELECT p.pair, p.ref, p.rep, a.y, a.x, a.re * b.re + a.im * b.im AS re, a.im * b.re - a.re * b.im AS im, a.re * a.re + a.im * a.im AS i1, b.re * b.re + b.im * b.im AS i2 FROM pairs p JOIN slc a ON a.date = p.ref JOIN slc b ON b.date = p.rep AND b.y = a.y AND b.x = a.x)"


@query(f", {DIFF} SELECT pair, y, x, {r('re', 4)} AS re, {r('im', 4)} AS im FROM diff")
def phase_difference(spark, sf):
    return rounded(phase.phase_difference(S.pairs(spark, sf), S.slc(spark, sf)).select("pair", "y", "x", "re", "im"), "re", "im", digits=4)


@query(f", {DIFF} SELECT pair, ref, rep, y, x, {r('atan2(im, re)')} AS phase, CASE WHEN i1 * i2 > 0 THEN {r('least(1e0, greatest(0e0, sqrt(re * re + im * im) / sqrt(i1 * i2)))')} END AS correlation FROM diff")
def interferogram_single_look(spark, sf):
    return rounded(phase.single_look(S.pairs(spark, sf), S.slc(spark, sf)), "phase", "correlation")


@query()
def interferogram_multi_look(spark, sf):
    return phase.multi_look(S.pairs(spark, sf), S.slc(spark, sf), (2, 2), psize=4)


def _turn(k: str, re: str, im: str, sign: int) -> tuple[str, str]:
    """(re, im) times exp(sign * i * pi / 2 * k), whose powers are 1, i, -1, -i."""
    back = f"({sign} * ({k}) % 4 + 4) % 4"
    return f"CASE {back} WHEN 0 THEN {re} WHEN 1 THEN -({im}) WHEN 2 THEN -({re}) ELSE {im} END", f"CASE {back} WHEN 0 THEN {im} WHEN 1 THEN {re} WHEN 2 THEN -({im}) ELSE -({re}) END"


FORWARD, BACK = _turn("f.u * (z.y - z.i) + f.v * (z.x - z.j)", "z.re", "z.im", -1), _turn("s.u * c.a + s.v * c.b", "s.re", "s.im", 1)


@query(f""", {DIFF}, z AS (SELECT pair, ref, rep, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, i.i, j.j, re, im FROM diff, range(0, 8, 2) i(i), range(0, 6, 2) j(j) WHERE y BETWEEN i.i AND i.i + 3 AND x BETWEEN j.j AND j.j + 3),
f AS (SELECT u, v FROM range(4) a(u), range(4) b(v)),
al AS (SELECT pair, i, j, 1 - 0.5e0 * count(CASE WHEN y - i IN (1, 2) AND x - j IN (1, 2) THEN 1 END) / 4 AS alpha FROM z GROUP BY ALL),
q AS (SELECT pair, ref, rep, i, j, u, v, sum({FORWARD[0]}) AS re, sum({FORWARD[1]}) AS im FROM z, f GROUP BY ALL),
s AS (SELECT q.pair, ref, rep, q.i, q.j, u, v, re * pow(sqrt(re * re + im * im), alpha) AS re, im * pow(sqrt(re * re + im * im), alpha) AS im FROM q JOIN al ON al.pair = q.pair AND al.i = q.i AND al.j = q.j),
c AS (SELECT a, b, CASE WHEN a IN (1, 2) AND b IN (1, 2) THEN 1 ELSE 0 END AS w FROM range(4) a(a), range(4) b(b)),
o AS (SELECT s.pair, s.ref, s.rep, s.i + c.a AS y, s.j + c.b AS x, any_value(c.w) * sum({BACK[0]}) / 16 AS re, any_value(c.w) * sum({BACK[1]}) / 16 AS im FROM s, c GROUP BY s.pair, s.ref, s.rep, s.i, s.j, c.a, c.b),
t AS (SELECT pair, ref, rep, y, x, sum(re) AS re, sum(im) AS im FROM o GROUP BY ALL)
SELECT pair, ref, rep, CAST(y AS DOUBLE) AS y, CAST(x AS DOUBLE) AS x, {r('re', 0)} AS re, {r('im', 0)} AS im FROM t WHERE abs(re) + abs(im) > 1e-3""")
def goldstein(spark, sf):
    diff = phase.phase_difference(S.pairs(spark, sf), S.slc(spark, sf))
    return rounded(phase.goldstein(diff.withColumn("correlation", F.lit(0.5)), 4, GRID).filter("abs(re) + abs(im) > 1e-3"), "re", "im", digits=0)


def _reflected(i: str, n: int) -> str:
    return f"CAST(CASE WHEN {i} < 0 THEN -({i}) - 1 WHEN {i} >= {n} THEN {2 * n - 1} - ({i}) ELSE {i} END AS INTEGER)"


def _smooth(name: str, source: str, keys: str, values: list[str], sigma: tuple[float, float], truncate: float, ny: int, nx: int) -> str:
    """SQL of a NULL-aware Gaussian: ``name`` has the keys, whole numbers y and x, and the values of ``source`` smoothed."""
    reach = [int(truncate * x + 0.5) for x in sigma]
    k = f"exp(-0.5e0 * (a.a / {sigma[0]!r}e0) * (a.a / {sigma[0]!r}e0)) * exp(-0.5e0 * (b.b / {sigma[1]!r}e0) * (b.b / {sigma[1]!r}e0))"
    key, on = (f"{keys}, ", f"s.{keys} = g.{keys} AND ") if keys else ("", "")
    slices = f"(SELECT DISTINCT {keys} FROM {source}) u, " if keys else ""
    parts = ", ".join(f"CASE WHEN sum(CASE WHEN s.{v} IS NOT NULL THEN g.k END) > 1e-17 THEN sum(g.k * s.{v}) / sum(CASE WHEN s.{v} IS NOT NULL THEN g.k END) END AS {v}" for v in values)
    return f"""{name}_g AS (SELECT {key}yy.y, xx.x, {_reflected('yy.y + a.a', ny)} AS sy, {_reflected('xx.x + b.b', nx)} AS sx, {k} AS k
  FROM {slices}range({ny}) yy(y), range({nx}) xx(x), range({-reach[0]}, {reach[0] + 1}) a(a), range({-reach[1]}, {reach[1] + 1}) b(b)),
{name} AS (SELECT {'g.' + key if keys else ''}g.y, g.x, {parts} FROM {name}_g g JOIN {source} s ON {on}s.y = g.sy AND s.x = g.sx GROUP BY ALL)"""


@query(f", {_smooth('o', 'stack', 'date', ['v'], (1.0, 1.5), 4.0, 12, 10)} SELECT date, CAST(y AS DOUBLE) AS y, CAST(x AS DOUBLE) AS x, {r('v', 4)} AS v FROM o WHERE v IS NOT NULL")
def gaussian(spark, sf):
    return rounded(raster.gaussian(S.stack(spark, sf), ["v"], (1.0, 1.5), ["date"], grid=GRID).filter("v IS NOT NULL"), "v", digits=4)


@query(f""", {_smooth('a', 'total', '', ['v'], (2 / 5.3, 2 / 5.3), 3.0, 12, 10)}, b AS (SELECT y // 2 AS y, x // 2 AS x, avg(v) AS v FROM a GROUP BY ALL),
{_smooth('c', 'b', '', ['v'], (math.sqrt(252) / 5.3 / 2, math.sqrt(252) / 5.3 / 2), 3.0, 6, 5)} SELECT t.y, t.x, {r('c.v', 4)} AS v FROM total t JOIN c ON c.y = floor(t.y / 2) AND c.x = floor(t.x / 2)""")
def gaussian_two_stage(spark, sf):
    return rounded(raster.two_stage_gaussian(S.total(spark, sf), "v", 16.0, (1.0, 1.0), resolution=2.0), "v", digits=4)


MULTILOOK = f"""{DIFF}, si AS (SELECT date, y, x, re * re + im * im AS i FROM slc), {_smooth('gi', 'si', 'date', ['i'], (2 / 5.3, 2 / 5.3), 4.0, 12, 10)}, {_smooth('gd', 'diff', 'pair', ['re', 'im'], (2 / 5.3, 2 / 5.3), 4.0, 12, 10)},
mi AS (SELECT date, y // 2 AS y, x // 2 AS x, avg(i) AS i FROM gi GROUP BY ALL), md AS (SELECT pair, y // 2 AS y, x // 2 AS x, avg(re) AS re, avg(im) AS im FROM gd GROUP BY ALL),
looked AS (SELECT p.pair, p.ref, p.rep, md.y * 2 + 0.5e0 AS y, md.x * 2 + 0.5e0 AS x, md.re, md.im, a.i AS i1, b.i AS i2 FROM md JOIN pairs p ON p.pair = md.pair JOIN mi a ON a.date = p.ref AND a.y = md.y AND a.x = md.x JOIN mi b ON b.date = p.rep AND b.y = md.y AND b.x = md.x)"""


@query(f", {MULTILOOK} SELECT pair, ref, rep, y, x, {r('atan2(im, re)')} AS phase, CASE WHEN i1 * i2 > 0 THEN {r('least(1e0, greatest(0e0, sqrt(re * re + im * im) / sqrt(i1 * i2)))')} END AS correlation FROM looked")
def interferogram_looks(spark, sf):
    """All pairs' phase and correlation by the whole chain: intensities, phase difference, low-pass, block means, coherence."""
    return rounded(phase.multi_look(S.pairs(spark, sf), S.slc(spark, sf), (2, 2)), "phase", "correlation")


@query()
def unwrap_2d(spark, sf):
    return unwrap2d.unwrap2d(S.pair_data(spark, sf), config=unwrap2d.Config(tile=6), components=True)


# ---- interpolation

HOLES = "holes AS (SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CASE WHEN (CAST(y AS INTEGER) * 7 + CAST(x AS INTEGER) * 5) % 4 > 0 THEN v END AS v FROM total)"


def _holes(spark, sf):
    keep = (F.col("y") * 7 + F.col("x") * 5) % 4 > 0
    return S.total(spark, sf).select("y", "x", F.when(keep, F.col("v")).alias("v"))


@query(f""", {HOLES}, k AS (SELECT a.y, a.x, b.v, row_number() OVER (PARTITION BY a.y, a.x ORDER BY (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x), b.y, b.x) AS n FROM holes a JOIN holes b ON a.v IS NULL AND b.v IS NOT NULL AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) < 9)
SELECT CAST(h.y AS DOUBLE) AS y, CAST(h.x AS DOUBLE) AS x, coalesce(h.v, k.v) AS v FROM holes h LEFT JOIN k ON k.y = h.y AND k.x = h.x AND k.n = 1""")
def nearest_fill(spark, sf):
    return raster.fill_nearest(_holes(spark, sf), "v", 3, grid=GRID)


SPOTS = "spots AS (SELECT DISTINCT (c_custkey % 44) / 4e0 AS y, (c_nationkey % 18) / 2e0 AS x FROM customer)"


def _spots(spark, sf):
    return table(spark, sf, "customer").select((F.col("c_custkey") % 44 / 4.0).alias("y"), (F.col("c_nationkey") % 18 / 2.0).alias("x")).distinct()


@query(f""", {SPOTS}, t AS (SELECT y, x, floor(y) AS a, floor(x) AS b, y - floor(y) AS f, x - floor(x) AS g FROM spots),
u AS (SELECT t.y, t.x, least(t.a + i, 11) AS cy, least(t.b + j, 9) AS cx, CASE WHEN i = 0 THEN 1 - f ELSE f END * CASE WHEN j = 0 THEN 1 - g ELSE g END AS w FROM t, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j))
SELECT u.y, u.x, {r('sum(u.w * c.v)')} AS v FROM u JOIN total c ON c.y = u.cy AND c.x = u.cx GROUP BY u.y, u.x HAVING count(*) = 4""")
def regrid_linear(spark, sf):
    return rounded(raster.regrid(S.total(spark, sf), "v", GRID, _spots(spark, sf), "linear").filter("v IS NOT NULL"), "v")


@query(f", {SPOTS} SELECT s.y, s.x, c.v FROM spots s JOIN total c ON c.y = least(round(s.y), 11) AND c.x = least(round(s.x), 9)")
def regrid_nearest(spark, sf):
    return raster.regrid(S.total(spark, sf), "v", GRID, _spots(spark, sf), "nearest")


def _taps(weight: str, first: int, last: int) -> str:
    """SQL of an interpolation by separable taps from ``first`` to ``last`` with unnormalised weights of the distance d."""
    axis = lambda c, n: f"w{c} AS (SELECT DISTINCT s.{c}, {_reflected(f'CAST(floor(s.{c}) AS INTEGER) + k.k', n)} AS i, ({weight.format(d=f'(s.{c} - floor(s.{c}) - k.k)')}) AS w, k.k FROM spots s, range({first}, {last + 1}) k(k)), n{c} AS (SELECT {c}, i, w / sum(w) OVER (PARTITION BY {c}) AS w FROM w{c})"
    return f", {SPOTS}, {axis('y', 12)}, {axis('x', 10)} SELECT s.y, s.x, {r('sum(a.w * b.w * t.v)', 4)} AS v FROM spots s JOIN ny a ON a.y = s.y JOIN nx b ON b.x = s.x JOIN total t ON t.y = a.i AND t.x = b.i GROUP BY s.y, s.x HAVING count(*) = {(last - first + 1) ** 2}"


CUBIC = "CASE WHEN abs{d} <= 1 THEN (1.25e0 * abs{d} - 2.25e0) * abs{d} * abs{d} + 1 ELSE ((-0.75e0 * abs{d} + 3.75e0) * abs{d} - 6) * abs{d} + 3 END"
LANCZOS = f"CASE WHEN abs{{d}} < 1e-9 THEN 1e0 ELSE sin({PI} * {{d}}) * sin({PI} * {{d}} / 4) * 4 / ({PI} * {PI} * {{d}} * {{d}}) END"


@query(_taps(CUBIC, -1, 2))
def regrid_cubic(spark, sf):
    return rounded(raster.regrid(S.total(spark, sf), "v", GRID, _spots(spark, sf), "cubic").filter("v IS NOT NULL"), "v", digits=4)


@query(_taps(LANCZOS, -3, 4))
def regrid_lanczos(spark, sf):
    return rounded(raster.regrid(S.total(spark, sf), "v", GRID, _spots(spark, sf), "lanczos").filter("v IS NOT NULL"), "v", digits=4)


@query("""SELECT date, y, x, v FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY (y - 4.2e0) * (y - 4.2e0) + (x - 5.1e0) * (x - 5.1e0), y, x) AS n FROM stack) WHERE n = 1""")
def nearest_point(spark, sf):
    return raster.nearest_point(S.stack(spark, sf), 4.2, 5.1, ["v"], ["date"])


@query(f", a AS (SELECT y, x, CAST(y * 3 AS DOUBLE) AS azi, CAST(x * 2 + 1 AS DOUBLE) AS rng, v FROM total), {SPOTS}, k AS (SELECT s.y, s.x, a.v, row_number() OVER (PARTITION BY s.y, s.x ORDER BY (s.y - a.azi) * (s.y - a.azi) + (s.x - a.rng) * (s.x - a.rng), a.azi, a.rng) AS n FROM spots s JOIN a ON (s.y - a.azi) * (s.y - a.azi) + (s.x - a.rng) * (s.x - a.rng) < 2.25) SELECT s.y, s.x, k.v FROM spots s LEFT JOIN k ON k.y = s.y AND k.x = s.x AND k.n = 1")
def nearest_join(spark, sf):
    known = S.total(spark, sf).select((F.col("y") * 3).alias("y"), (F.col("x") * 2 + 1).alias("x"), "v")
    return raster.nearest_join(_spots(spark, sf), known, ["v"], 1.5)


# ---- topography and units

SLOPE = "slopes AS (SELECT y, x, coalesce((lead(v) OVER a - lag(v) OVER a) / 20, (lead(v) OVER a - v) / 10, (v - lag(v) OVER a) / 10) AS gy, coalesce((lead(v) OVER b - lag(v) OVER b) / 40, (lead(v) OVER b - v) / 20, (v - lag(v) OVER b) / 20) AS gx FROM total WINDOW a AS (PARTITION BY x ORDER BY y), b AS (PARTITION BY y ORDER BY x))"


@query(f", {SLOPE} SELECT y, x, {r('degrees(atan(sqrt(gy * gy + gx * gx)))')} AS slope FROM slopes")
def topo_slope(spark, sf):
    return rounded(raster.slope_degrees(S.total(spark, sf), "v", (10.0, 20.0)), "slope")


@query(f", w AS (SELECT y, x, v - lag(v) OVER (PARTITION BY y ORDER BY x) AS d FROM total), m AS (SELECT avg(d) AS m FROM w) SELECT y, x, {r('d / m', 4)} AS variation FROM w, m WHERE d IS NOT NULL AND m <> 0")
def topo_variation(spark, sf):
    return rounded(raster.variation(S.total(spark, sf), "v"), "variation", digits=4)


INC = "atan2(sqrt((0.3e0 + x / 100) * (0.3e0 + x / 100) + 0.01e0), 0.8e0)"


@query(f"""SELECT y, x, {r(INC)} AS incidence, {r('-79.58e0 * 0.0554658e0 * (v / 100)', 4)} AS los_mm, {r(f'-79.58e0 * 0.0554658e0 * (v / 100) / cos({INC})', 4)} AS vertical_mm,
  {r(f'-79.58e0 * 0.0554658e0 * (v / 100) / sin({INC})', 4)} AS eastwest_mm, {r(f'-0.0554658e0 * (v / 100) * (800000e0 + x * (100000e0 / 9)) * cos({INC}) / (4 * {PI} * 50)', 4)} AS elevation_m FROM total""")
def displacement_units(spark, sf):
    w = 0.0554658
    p = F.col("v") / 100
    inc = C.incidence_angle(F.lit(0.3) + F.col("x") / 100, F.lit(0.1), F.lit(0.8))
    out = S.total(spark, sf).select("y", "x", inc.alias("incidence"), C.los_displacement_mm(p, w).alias("los_mm"), C.vertical_displacement_mm(p, inc, w).alias("vertical_mm"), C.eastwest_displacement_mm(p, inc, w, True).alias("eastwest_mm"), C.elevation_m(p, C.slant_at("x", 10, 800000.0, 900000.0), inc, w, 50.0).alias("elevation_m"))
    return rounded(rounded(out, "incidence"), "los_mm", "vertical_mm", "eastwest_mm", "elevation_m", digits=4)


@query(f"SELECT date, y, x, {r('0.5e0 * v + 0.2e0 * (v + 1) + 0.8e0 * (v - 1)')} AS los FROM stack")
def los_projection(spark, sf):
    s = S.stack(spark, sf).select("date", "y", "x", F.lit(0.5).alias("e"), F.lit(0.2).alias("n"), F.lit(0.8).alias("u"), F.col("v").alias("dx"), (F.col("v") + 1).alias("dy"), (F.col("v") - 1).alias("dz"))
    return rounded(s.select("date", "y", "x", C.los_projection(("e", "n", "u"), ("dx", "dy", "dz")).alias("los")), "los")


TIDE = "1000e0 / (-79.58e0 * 0.0554658e0) * (y / 1000)"


@query(f"SELECT pair, y, x, {r(TIDE)} AS tide_rad, {r(wrapped_sql(f'phase - {TIDE}'))} AS phase FROM data")
def tidal_correction(spark, sf):
    tide = C.tidal_los_rad(F.col("y") / 1000, 0.0554658)
    return rounded(S.pair_data(spark, sf).select("pair", "y", "x", tide.alias("tide_rad"), C.tidal_correction_wrap("phase", tide).alias("phase")), "tide_rad", "phase")


RADAR = {"near_range": 800000.0, "rng_samp_rate": 64345238.0, "stretch_r": 0.0, "a_stretch_r": 0.0, "earth_radius": 6371000.0, "SC_height": 693000.0, "SC_height_start": 693000.0, "SC_height_end": 693100.0, "num_lines": 12, "wavelength": 0.0554658, "PRF": 486.5, "SC_vel": 7500.0, "num_rng_bins": 10, "clock_start": 0.0}
TOPO = f"""b AS (SELECT ref, rep, pair, 100 + baseline AS b0, 110 + baseline AS b1, 30e0 AS a0, 31e0 AS a1 FROM pairs),
g AS (SELECT b.*, t.y, t.x, t.v / 10 AS topo, t.y / 11 AS f, {RADAR['near_range']!r}e0 + t.x * ({geometry.SPEED_OF_LIGHT!r}e0 / (2 * {RADAR['rng_samp_rate']!r}e0)) AS rho FROM b, total t),
h AS (SELECT *, b0 * cos(radians(a0)) + (b1 * cos(radians(a1)) - b0 * cos(radians(a0))) * f AS bh, b0 * sin(radians(a0)) + (b1 * sin(radians(a1)) - b0 * sin(radians(a0))) * f AS bv,
  6371000e0 + (693000e0 + (-100) * f + 200 * f * f) AS c, 6371000e0 + topo AS r FROM g),
k AS (SELECT *, (rho * rho + c * c - r * r) / (2 * rho * c) AS ct FROM h),
d AS (SELECT *, sqrt(rho * rho + bh * bh + bv * bv - 2 * rho * sqrt(bh * bh + bv * bv) * (sqrt(1 - ct * ct) * cos(atan2(bv, bh)) - ct * sin(atan2(bv, bh)))) - rho AS drho FROM k)"""


@query(f", {TOPO} SELECT pair, y, x, {r(f'cos(-4 * {PI} / 0.0554658e0 * drho)', 3)} AS re, {r(f'sin(-4 * {PI} / 0.0554658e0 * drho)', 3)} AS im FROM d")
def topographic_phase(spark, sf):
    p = S.pairs(spark, sf)
    zero = F.lit(0.0)
    second = p.select("ref", "rep", F.lit(1.0).alias("tspan"), (100 + F.col("baseline")).alias("baseline_start"), zero.alias("baseline_center"), (110 + F.col("baseline")).alias("baseline_end"), F.lit(30.0).alias("alpha_start"), zero.alias("alpha_center"), F.lit(31.0).alias("alpha_end"), *(zero.alias(f"B_offset_{k}") for k in ("start", "center", "end")))
    topo = S.total(spark, sf).select("y", "x", (F.col("v") / 10).alias("topo"))
    out = phase.topographic_phase(topo, p, RADAR, second)
    return rounded(out.select("pair", "y", "x", "re", "im"), "re", "im", digits=3)


# ---- geocoding


def _orbit(spark) -> DataFrame:
    t = F.col("id") * 10.0
    a = (t - 200) * (2 * math.pi / 5900)
    radius = 7064000.0
    return spark.range(41).select(t.alias("clock"), (F.lit(radius) * F.cos(a)).alias("px"), F.lit(0.0).alias("py"), (F.lit(radius) * F.sin(a)).alias("pz"), (F.lit(-radius * 2 * math.pi / 5900) * F.sin(a)).alias("vx"), F.lit(0.0).alias("vy"), (F.lit(radius * 2 * math.pi / 5900) * F.cos(a)).alias("vz"))


def _dem(spark, sf) -> DataFrame:
    return S.total(spark, sf).select((F.col("y") / 50).alias("lat"), (4 + F.col("x") / 50).alias("lon"), (F.col("v") / 100).alias("ele"))


def _scene() -> dict[str, float]:
    return RADAR | {"clock_start": 190 / 86400, "num_lines": 20000, "num_rng_bins": 200000, "near_range": 700000.0}


def _ecef(source: str, height: str, keep: str) -> str:
    """SQL of Earth-fixed places px, py, pz of rows with lat, lon."""
    e2 = geocode.EARTH_F * (2 - geocode.EARTH_F)
    n = f"{geocode.EARTH_A!r}e0 / sqrt(1 - {e2!r}e0 * sin(radians(lat)) * sin(radians(lat)))"
    return f"SELECT {keep}, ({n} + {height}) * cos(radians(lat)) * cos(radians(lon)) AS px, ({n} + {height}) * cos(radians(lat)) * sin(radians(lon)) AS py, ({n} * {1 - e2!r}e0 + {height}) * sin(radians(lat)) AS pz FROM {source}"


#: The orbit is a circle in the plane of x and z, to which the satellite is nearest where its angle is that of the point. Its
#: interpolation from state vectors is off by up to 0.0005 lines, so lines are compared as whole numbers.
DEM = "dem AS (SELECT y / 50 AS lat, 4 + x / 50 AS lon, v / 100 AS ele FROM total)"
NEAREST = "sqrt((px - 7064000e0 * cos(angle)) * (px - 7064000e0 * cos(angle)) + py * py + (pz - 7064000e0 * sin(angle)) * (pz - 7064000e0 * sin(angle)))"


def _radar(source: str) -> str:
    step = geometry.SPEED_OF_LIGHT / RADAR["rng_samp_rate"] / 2
    return f"e AS ({_ecef(source, 'ele', 'lat, lon, ele')}), a AS (SELECT *, atan2(pz, px) AS angle FROM e), trans AS (SELECT lat, lon, ele, (angle * (5900e0 / {TAU}) + 200 - 190) * 486.5e0 AS azi, ({NEAREST} - 700000e0) / {step!r}e0 AS rng, {NEAREST} AS slant FROM a)"


IN_SCENE = "azi >= 0 AND azi < 20000 AND rng >= 0 AND rng < 200000"


@query(f", {DEM}, {_radar('dem')} SELECT lat, lon, ele, {r('azi', 0)} AS azi, {r('rng', 1)} AS rng FROM trans WHERE {IN_SCENE}")
def transform(spark, sf):
    out = geocode.transform(_dem(spark, sf), _orbit(spark), _scene())
    return rounded(rounded(out, "azi", digits=0), "rng", digits=1)


@query(f""", {DEM}, {_radar('dem')}, known AS (SELECT * FROM trans WHERE {IN_SCENE}), target AS (SELECT DISTINCT round(azi / 100) * 100 AS y, round(rng / 400) * 400 AS x FROM known),
k AS (SELECT t.y, t.x, n.lat, n.lon, n.ele, row_number() OVER (PARTITION BY t.y, t.x ORDER BY (t.y - n.azi) * (t.y - n.azi) + (t.x - n.rng) * (t.x - n.rng), n.azi, n.rng) AS k FROM target t JOIN known n ON (t.y - n.azi) * (t.y - n.azi) + (t.x - n.rng) * (t.x - n.rng) < 640000)
SELECT t.y, t.x, k.lat AS lt, k.lon AS ll, k.ele FROM target t LEFT JOIN k ON k.y = t.y AND k.x = t.x AND k.k = 1""")
def inverse_transform(spark, sf):
    trans = geocode.transform(_dem(spark, sf), _orbit(spark), _scene())
    target = trans.select((F.round(F.col("azi") / 100) * 100).alias("y"), (F.round(F.col("rng") / 400) * 400).alias("x")).distinct()
    return geocode.inverse(trans, target, (100.0, 400.0))


@query(f""", {DEM}, e AS ({_ecef('dem', 'ele', 'lat, lon, ele')}), a AS (SELECT *, atan2(pz, px) AS angle FROM e),
d AS (SELECT *, (7064000e0 * cos(angle) - px) / {NEAREST} AS dx, -py / {NEAREST} AS dy, (7064000e0 * sin(angle) - pz) / {NEAREST} AS dz FROM a)
SELECT lat, lon, ele, {r('-sin(radians(lon)) * dx + cos(radians(lon)) * dy', 5)} AS look_E, {r('-sin(radians(lat)) * cos(radians(lon)) * dx - sin(radians(lat)) * sin(radians(lon)) * dy + cos(radians(lat)) * dz', 5)} AS look_N,
  {r('cos(radians(lat)) * cos(radians(lon)) * dx + cos(radians(lat)) * sin(radians(lon)) * dy + sin(radians(lat)) * dz', 5)} AS look_U FROM d""")
def look_vectors(spark, sf):
    return rounded(geocode.look_vectors(_dem(spark, sf), _orbit(spark)), "look_E", "look_N", "look_U", digits=5)


@query(f""", {DEM}, spots AS (SELECT CAST(round(lat * 50) AS INTEGER) AS iy, CAST(round((lon - 4) * 50) AS INTEGER) AS ix, lat + 0.004e0 AS lat, lon + 0.004e0 AS lon FROM dem),
points AS (SELECT s.lat, s.lon, sum(t.v / 100 * CASE WHEN a.a = 0 THEN 0.8e0 ELSE 0.2e0 END * CASE WHEN b.b = 0 THEN 0.8e0 ELSE 0.2e0 END) AS ele FROM spots s, range(2) a(a), range(2) b(b), total t WHERE t.y = least(s.iy + a.a, 11) AND t.x = least(s.ix + b.b, 9) GROUP BY s.lat, s.lon HAVING count(*) = 4),
{_radar('points')} SELECT lat, lon, {r('ele', 4)} AS ele, {r('azi', 0)} AS azi, {r('rng', 1)} AS rng, {r('slant', 1)} AS slant FROM trans""")
def geocode_points(spark, sf):
    grid = Grid(0.0, 0.02, 12, 4.0, 0.02, 10)
    out = geocode.geocode_points(_dem(spark, sf).select((F.col("lat") + 0.004).alias("lat"), (F.col("lon") + 0.004).alias("lon")), _dem(spark, sf), grid, _orbit(spark), _scene())
    return rounded(rounded(rounded(out, "ele", digits=4), "azi", digits=0), "rng", "slant", digits=1)


def _degrees(a: float, b: float) -> str:
    return f"radians(({a!r}e0 + {b!r}e0 * day) % 360)"


def _tide(times: str, grid: str) -> str:
    """SQL of ``tide``: date, y, x, lon, lat, dx, dy, dz from days since noon of 2000-01-01 and a grid; a low-precision Sun and Moon."""
    spin = lambda k: f"cos(turn) * {k}x + sin(turn) * {k}y AS {k}x, -sin(turn) * {k}x + cos(turn) * {k}y AS {k}y, {k}z"
    part = lambda k, mass, axis: f"{mass!r}e0 * {geocode.EARTH_A!r}e0 ** 4 / (d{k} * d{k} * d{k}) * (0.6078e0 * p{axis} / pr * (1.5e0 * c{k} * c{k} - 0.5e0) + 3 * 0.0847e0 * c{k} * ({k}{axis} / d{k} - c{k} * p{axis} / pr))"
    moved = ", ".join(f"{part('s', 332946.0, a)} + {part('m', 0.0123000371, a)} AS t{a}" for a in "xyz")
    along = lambda k: f"(px * {k}x + py * {k}y + pz * {k}z) / (pr * d{k}) AS c{k}"
    return f"""t0 AS (SELECT *, radians(23.439e0 - 0.0000004e0 * day) AS eps, {_degrees(357.528, 0.9856003)} AS g, {_degrees(218.316, 13.176396)} AS long, {_degrees(134.963, 13.064993)} AS anomaly, {_degrees(93.272, 13.229350)} AS node, {_degrees(280.46061837, 360.98564736629)} AS turn FROM {times}),
t1 AS (SELECT *, radians((280.460e0 + 0.9856474e0 * day) % 360 + 1.915e0 * sin(g) + 0.020e0 * sin(2 * g)) AS lam, 149597870700e0 * (1.00014e0 - 0.01671e0 * cos(g) - 0.00014e0 * cos(2 * g)) AS au,
  long + radians(6.289e0) * sin(anomaly) AS ml, radians(5.128e0) * sin(node) AS mb, 385000560e0 - 20905000e0 * cos(anomaly) AS mr FROM t0),
t2 AS (SELECT date, turn, au * cos(lam) AS sx, au * cos(eps) * sin(lam) AS sy, au * sin(eps) * sin(lam) AS sz, mr * cos(mb) * cos(ml) AS mx,
  cos(eps) * (mr * cos(mb) * sin(ml)) - sin(eps) * (mr * sin(mb)) AS my, sin(eps) * (mr * cos(mb) * sin(ml)) + cos(eps) * (mr * sin(mb)) AS mz FROM t1),
t3 AS (SELECT date, {spin('s')}, {spin('m')} FROM t2), t4 AS (SELECT *, sqrt(sx * sx + sy * sy + sz * sz) AS ds, sqrt(mx * mx + my * my + mz * mz) AS dm FROM t3),
g0 AS ({_ecef(grid, '0e0', 'y, x, lon, lat')}), g1 AS (SELECT *, sqrt(px * px + py * py + pz * pz) AS pr FROM g0), g2 AS (SELECT *, {along('s')}, {along('m')} FROM g1, t4), g3 AS (SELECT date, y, x, lon, lat, {moved} FROM g2),
tide AS (SELECT date, y, x, lon, lat, -sin(radians(lon)) * tx + cos(radians(lon)) * ty AS dx, -sin(radians(lat)) * cos(radians(lon)) * tx - sin(radians(lat)) * sin(radians(lon)) * ty + cos(radians(lat)) * tz AS dy,
  cos(radians(lat)) * cos(radians(lon)) * tx + cos(radians(lat)) * sin(radians(lon)) * ty + sin(radians(lat)) * tz AS dz FROM g3)"""


PLACES = "places AS (SELECT y, x, x / 10 AS lon, y / 10 AS lat FROM total)"


@query(f", times AS (SELECT date, CAST(date_diff('day', DATE '2000-01-01', date) AS DOUBLE) AS day FROM scenes), {PLACES}, {_tide('times', 'places')} SELECT date, y, x, lon, lat, {r('dx', 5)} AS dx, {r('dy', 5)} AS dy, {r('dz', 5)} AS dz FROM tide")
def solid_tides(spark, sf):
    times = S.scenes(spark, sf).select((F.col("date").cast("timestamp") + F.expr("interval 43200 seconds")).alias("datetime"))
    return rounded(geocode.tides(S.total(spark, sf).select("y", "x", (F.col("x") / 10).alias("lon"), (F.col("y") / 10).alias("lat")), times), "dx", "dy", "dz", digits=5)


@query(f""", times AS (SELECT date, date_diff('day', DATE '2000-01-01', date) - 0.5e0 AS day FROM scenes), {PLACES}, {_tide('times', 'places')}
SELECT p.ref, p.rep, a.y, a.x, {r('0.4e0 * (b.dx - a.dx) + 0.1e0 * (b.dy - a.dy) + 0.9e0 * (b.dz - a.dz)', 5)} AS tidal_los FROM pairs p JOIN tide a ON a.date = p.ref JOIN tide b ON b.date = p.rep AND b.y = a.y AND b.x = a.x""")
def tidal_los(spark, sf):
    times = S.scenes(spark, sf).select(F.col("date").cast("timestamp").alias("datetime"))
    grid = S.total(spark, sf).select("y", "x", (F.col("x") / 10).alias("lon"), (F.col("y") / 10).alias("lat"))
    look = S.total(spark, sf).select("y", "x", F.lit(0.4).alias("look_E"), F.lit(0.1).alias("look_N"), F.lit(0.9).alias("look_U"))
    return rounded(geocode.tidal_los(S.pairs(spark, sf), geocode.tides(grid, times).select("date", "y", "x", "dx", "dy", "dz"), look, GRID), "tidal_los", digits=5)


TRANS = "trans AS (SELECT y / 50 AS lat, x / 50 AS lon, CAST(round(y * 0.9e0 + 0.3e0) AS INTEGER) AS iy, CAST(round(x * 1.3e0 - 1) AS INTEGER) AS ix FROM total)"


@query(f", {TRANS} SELECT s.date, t.lat, t.lon, s.v FROM trans t JOIN stack s ON s.y = t.iy AND s.x = t.ix WHERE t.iy BETWEEN 0 AND 11 AND t.ix BETWEEN 0 AND 9")
def radar_to_geo(spark, sf):
    trans = S.total(spark, sf).select((F.col("y") / 50).alias("lat"), (F.col("x") / 50).alias("lon"), (F.col("y") * 0.9 + 0.3).alias("azi"), (F.col("x") * 1.3 - 1).alias("rng"))
    return geocode.radar_to_geo(S.stack(spark, sf), trans, ["v"], GRID, ["date"])


@query(", inv AS (SELECT y, x, CAST(round(y * 0.5e0 + 0.3e0) AS INTEGER) AS iy, CAST(round(x * 0.7e0 + 0.1e0) AS INTEGER) AS ix FROM total) SELECT s.date, t.y, t.x, s.v FROM inv t JOIN stack s ON s.y = t.iy AND s.x = t.ix")
def geo_to_radar(spark, sf):
    inv = S.total(spark, sf).select("y", "x", (F.col("y") * 0.5 + 0.3).alias("lt"), (F.col("x") * 0.7 + 0.1).alias("ll"))
    return geocode.geo_to_radar(S.stack(spark, sf).select("date", F.col("y").alias("lat"), F.col("x").alias("lon"), "v"), inv, ["v"], GRID, ["date"])


# ---- catalogs and parameters


@query("""WITH s AS (SELECT 's1a-iw' || (event_id % 3 + 1) || '-slc-vv-' || strftime(ts, '%Y%m%dt%H%M%S') || '-' || strftime(ts, '%Y%m%dt%H%M%S') || '-012345-0abcde-00' || (event_id % 3 + 4) AS name, ts, event_id FROM events)
SELECT name, strftime(ts, '%Y-%m-%d') AS date, 'S1A' AS mission, CAST(event_id % 3 + 1 AS INTEGER) AS subswath, 'VV' AS polarization FROM s""", base=False)
def scene_names(spark, sf):
    stamp = F.date_format("ts", "yyyyMMdd't'HHmmss")
    name = F.concat(F.lit("s1a-iw"), (F.col("event_id") % 3 + 1).cast("string"), F.lit("-slc-vv-"), stamp, F.lit("-"), stamp, F.lit("-012345-0abcde-00"), (F.col("event_id") % 3 + 4).cast("string"))
    return catalog.named(table(spark, sf, "events").select(name.alias("name"))).select("name", "date", "mission", "subswath", "polarization")


@query("""WITH f AS (SELECT CAST(ts AS DATE) AS date, min(ts) AS t FROM events GROUP BY 1),
o AS (SELECT event_id, ts - INTERVAL 20 HOUR AS a, ts + INTERVAL 20 HOUR AS b, CASE WHEN event_id % 3 = 0 THEN 'POE' ELSE 'RES' END AS kind, ts AS created FROM events),
h AS (SELECT f.date, o.event_id, o.kind, row_number() OVER (PARTITION BY f.date ORDER BY CASE WHEN o.kind = 'POE' THEN 0 ELSE 1 END, o.created DESC, CAST(o.event_id AS VARCHAR)) AS n FROM f JOIN o
  ON CASE WHEN o.kind = 'RES' THEN o.a + INTERVAL 1 HOUR <= f.t AND f.t <= o.b - INTERVAL 5 MINUTE ELSE o.a <= f.t AND f.t <= o.b END)
SELECT strftime(f.date, '%Y-%m-%d') AS date, CAST(h.event_id AS VARCHAR) AS orbitpath, h.kind FROM f LEFT JOIN h ON h.date = f.date AND h.n = 1""", base=False)
def orbit_choice(spark, sf):
    e = table(spark, sf, "events")
    t = F.col("ts").cast("timestamp")
    scenes = e.select(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.lit("S1A").alias("mission"), t.alias("datetime"))
    orbits = e.select(F.col("event_id").cast("string").alias("path"), F.lit("S1A").alias("mission"), F.when(F.col("event_id") % 3 == 0, "POE").otherwise("RES").alias("kind"), t.alias("created"), (t - F.expr("interval 20 hours")).alias("start"), (t + F.expr("interval 20 hours")).alias("stop"))
    return catalog.valid_orbit(scenes, orbits).select("date", "orbitpath", "kind")


@query("""WITH r AS (SELECT user_id, event_id, ts, event_type, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
n AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM r)
SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS n FROM n GROUP BY ALL""", base=False)
def line_runs(spark, sf):
    out = catalog.runs(table(spark, sf, "events").select("user_id", "event_id", "event_type"), "event_id", "event_type", ("user_id",))
    return out.groupBy("user_id", F.col("run").cast("long").alias("run"), "event_type").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT user_id % 20 AS k, event_id // 40 AS line, event_id AS n FROM events),
e AS (SELECT k, line, count(*) AS n FROM p GROUP BY ALL HAVING count(*) > 1), q AS (SELECT k, n, lead(n) OVER (PARTITION BY k ORDER BY line) AS m FROM e)
SELECT CAST(k AS BIGINT) AS k, CAST(n + m + 1 AS INTEGER) AS corners, count(*) AS bursts FROM q WHERE m IS NOT NULL GROUP BY ALL""", base=False)
def burst_rings(spark, sf):
    pts = table(spark, sf, "events").select((F.col("user_id") % 20).alias("k"), F.col("event_id").alias("n"), F.floor(F.col("event_id") / 40).alias("line"), (F.col("value")).alias("lon"), (F.col("value") / 2).alias("lat"))
    return catalog.bursts(pts, ("k",)).groupBy("k", F.size("ring").alias("corners")).agg(F.count("*").alias("bursts"))


@query("""SELECT o_orderkey AS name FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""", base=False)
def missing_scenes(spark, sf):
    have = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("name"))
    return catalog.missing(table(spark, sf, "orders").select(F.col("o_orderkey").alias("name")), have)


@query("""WITH s AS (SELECT CAST(ts AS DATE) AS date, CAST(user_id % 3 + 1 AS INTEGER) AS subswath, min(ts) AS t FROM events GROUP BY ALL)
SELECT strftime(date, '%Y-%m-%d') AS date, min(t) AS datetime, CAST(string_agg(CAST(subswath AS VARCHAR), '' ORDER BY subswath) AS INTEGER) AS subswath FROM s GROUP BY date""", base=False)
def merged_catalog(spark, sf):
    s = table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date"), (F.col("user_id") % 3 + 1).cast("int").alias("subswath")).agg(F.min("ts").alias("datetime"), F.lit("A").alias("orbit"))
    return stats.group_merge(s.withColumn("path", F.col("subswath").cast("string"))).select("date", "datetime", "subswath")


def _params(spark, sf, salt: int) -> DataFrame:
    c = table(spark, sf, "customer")
    line = F.concat(F.lit("name"), (F.col("c_custkey") % 50).cast("string"), F.lit(" = "), ((F.col("c_custkey") + salt) % 7).cast("string"))
    return c.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("l")))), lambda x: x["l"]), "\n").alias("text")).select("c_nationkey", params.from_text(F.col("text")).alias("params"))


LAST = "SELECT c_nationkey, 'name' || (c_custkey % 50) AS name, arg_max((c_custkey + {0}) % 7, c_custkey) AS v FROM customer {1} GROUP BY ALL"


@query(f"WITH a AS ({LAST.format(0, '')}) SELECT c_nationkey, name, CAST(v AS VARCHAR) AS value FROM a", base=False)
def parameter_tables(spark, sf):
    return params.explode(_params(spark, sf, 0), "c_nationkey")


@query(f"WITH a AS ({LAST.format(0, '')}), b AS ({LAST.format(1, 'WHERE c_custkey % 50 < 10')}) SELECT a.c_nationkey, a.name, CAST(coalesce(b.v, a.v) AS VARCHAR) AS value FROM a LEFT JOIN b ON a.c_nationkey = b.c_nationkey AND a.name = b.name", base=False)
def parameter_override(spark, sf):
    a, b = _params(spark, sf, 0), _params(spark, sf, 1).withColumnRenamed("params", "other")
    few = F.map_filter("other", lambda k, v: F.substring(k, 5, 9).cast("int") < 10)
    return params.explode(a.join(b, "c_nationkey").select("c_nationkey", params.merge(F.col("params"), few).alias("params")), "c_nationkey")


@query(f"WITH a AS ({LAST.format(0, '')}), b AS ({LAST.format(1, 'WHERE c_custkey % 2 = 0')}), u AS (SELECT c_nationkey, name, v FROM a UNION ALL SELECT c_nationkey, name, v FROM b) SELECT c_nationkey, name, CAST(v AS VARCHAR) AS value FROM u GROUP BY ALL HAVING count(*) = 1", base=False)
def parameter_difference(spark, sf):
    """All nations' parameters against others that only even names have."""
    a = params.explode(_params(spark, sf, 0), "c_nationkey")
    b = params.explode(_params(spark, sf, 1), "c_nationkey").filter((F.substring("name", 5, 9).cast("int") % 2) == 0)
    return params.difference(a, b, "c_nationkey")


# ---- tiles and exports


@query("""WITH b AS (SELECT DISTINCT c_nationkey AS minx, -(c_nationkey % 5) AS miny FROM customer), t AS (SELECT unnest(range(minx, minx + 2)) AS lon, miny FROM b), u AS (SELECT DISTINCT lon, unnest(range(miny, miny + 2)) AS lat FROM t)
SELECT CAST(lat AS INTEGER) AS lat, CAST(lon AS INTEGER) AS lon, CASE WHEN lat < 0 THEN 'S' ELSE 'N' END || lpad(CAST(abs(lat) AS VARCHAR), 2, '0') || CASE WHEN lon < 0 THEN 'W' ELSE 'E' END || lpad(CAST(abs(lon) AS VARCHAR), 3, '0') AS tile FROM u""", base=False)
def degree_tiles(spark, sf):
    x, y = F.col("c_nationkey").cast("double"), -(F.col("c_nationkey") % 5).cast("double")
    boxes = table(spark, sf, "customer").select(x.alias("minx"), y.alias("miny"), (x + 1.5).alias("maxx"), (y + 2).alias("maxy")).distinct()
    return rasters.degree_tiles(boxes)


@query(f"""WITH b AS (SELECT DISTINCT CAST(c_nationkey * 7 - 60 AS DOUBLE) AS lon, CAST(c_nationkey * 3 - 30 AS DOUBLE) + 0.1e0 AS lat FROM customer)
SELECT DISTINCT CAST(floor((lon + 180) / 360 * 1024) AS INTEGER) AS x, CAST(floor((1 - asinh(tan(radians(lat))) / {PI}) / 2 * 1024) AS INTEGER) AS y, CAST(10 AS INTEGER) AS z FROM b""", base=False)
def web_tiles(spark, sf):
    lon, lat = (F.col("c_nationkey") * 7 - 60).cast("double"), (F.col("c_nationkey") * 3 - 30).cast("double") + 0.1
    boxes = table(spark, sf, "customer").select(lon.alias("minx"), lat.alias("miny"), lon.alias("maxx"), lat.alias("maxy")).distinct()
    return rasters.web_tiles(boxes, 10).select("x", "y", "z")


@query("SELECT date, round(x / 7, 6) + 0e0 AS lon, round(y / 7, 6) + 0e0 AS lat, round(v, 2) + 0e0 AS v FROM stack")
def export_csv(spark, sf):
    geo = S.stack(spark, sf).select("date", (F.col("x") / 7).alias("lon"), (F.col("y") / 7).alias("lat"), "v")
    return export.csv_rows(geo, "v", "date")


DAYS = [f"2024-01-{d:02d}" for d in range(1, 31)]  # all that the events have


@query(f"""SELECT x AS lon, y AS lat, {", ".join(f"max(CASE WHEN date = DATE '{d}' THEN round(v, 2) + 0e0 END) AS d{d[-2:]}" for d in DAYS)} FROM stack GROUP BY x, y""")
def export_pivot(spark, sf):
    geo = S.stack(spark, sf).select("date", F.col("x").alias("lon"), F.col("y").alias("lat"), "v")
    out = export.pivoted(geo, "v", "date", DAYS)
    return out.select("lon", "lat", *(F.col(f"`{d}`").alias(f"d{d[-2:]}") for d in DAYS))


@query("""SELECT '{"type":"Feature","properties":{"v":' || CAST(round(v, 2) + 0e0 AS VARCHAR) || '},"geometry":{"type":"Point","coordinates":[' || CAST(x AS VARCHAR) || ',' || CAST(y AS VARCHAR) || ']}}' AS value FROM total""")
def export_geojson(spark, sf):
    geo = S.total(spark, sf).select(F.col("x").alias("lon"), F.col("y").alias("lat"), "v")
    return export.geojson_lines(geo, "v")


@query("SELECT t.y AS lat, t.x AS lon, " + r("t.v", 4) + " AS v, CASE WHEN t.v >= 40 THEN " + r("greatest(t.v / 10 - 20, 0)", 4) + " END AS z FROM (SELECT y, x, v FROM total) t")
def on_topography(spark, sf):
    g = S.total(spark, sf).select(F.col("y").alias("lat"), F.col("x").alias("lon"), "v")
    topo = g.select("lat", "lon", (F.col("v") / 10 - 20).alias("ele"))
    out = export.on_topography(g.withColumn("m", F.when(F.col("v") >= 40, F.col("v"))), topo, values=["m"], sea_level=True)
    return rounded(out.select("lat", "lon", "v", "z"), "v", "z", digits=4)


def plot_series(data: DataFrame, order: Column) -> DataFrame:
    """The running mean that a series plot shows next to its points."""
    return data.withColumn("mean", F.avg("v").over(Window.partitionBy("y", "x").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


@query(f"SELECT date, y, x, v, {r('avg(v) OVER (PARTITION BY y, x ORDER BY date)')} AS mean FROM stack")
def plot_displacements(spark, sf):
    return rounded(plot_series(S.stack(spark, sf), F.col("date")), "mean")


def queries() -> dict[str, Query]:
    from fringework.plans import archive, wide  # noqa: F401  (they register their own)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from fringework.plans import archive, wide  # noqa: F401

    return dict(SQL)
