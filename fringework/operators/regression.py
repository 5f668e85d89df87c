"""Regressions over slices, pixels and dates from sums that Spark adds up; only normal equations are solved in Python."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fringework import shared
from fringework.functions.columns import finite
from fringework.operators import stats
from fringework.operators.inversion import dense, network, packed

YEAR = 365.25
#: Coefficients of so many slices are broadcast; more meet the data in a shuffle join.
MOST_SLICES = 200_000


def days(c: Column | str) -> Column:
    """Days since 1970 as a double, from a date or a timestamp."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp")) / 86_400_000_000.0


def _solver(size: int, l1: float = 0.0, l2: float = 0.0, rounds: int = 1000, tol: float = 1e-6):
    """Coefficients from the upper triangle of X'X (with X'y as its last column): least squares, or elastic net by coordinate descent."""

    @F.pandas_udf("array<double>")
    def solve(sums: pd.Series) -> pd.Series:
        out = []
        for s in sums:
            if s is None or np.isnan(np.asarray(s, float)).any():
                out.append(None)
                continue
            g = np.zeros((size + 1, size + 1))
            g[np.triu_indices(size + 1)] = np.asarray(s, float)
            g = g + np.triu(g, 1).T
            a, b = g[:size, :size], g[:size, size]
            if l1 or l2:
                x = np.zeros(size)
                for _ in range(rounds):
                    old = x.copy()
                    for j in range(size):
                        r = b[j] - a[j] @ x + a[j, j] * x[j]
                        penalised = j > 0  # the intercept comes first
                        x[j] = 0.0 if a[j, j] == 0 else np.sign(r) * max(0.0, abs(r) - l1 * penalised) / (a[j, j] + l2 * penalised)
                    if np.abs(x - old).max() < tol:
                        break
            else:
                x = np.linalg.lstsq(a, b, rcond=None)[0]
            out.append(x.tolist())
        return pd.Series(out)

    return solve


def regression(data: DataFrame, value: str, variables: list[str], keys: list[str], weight: str | None = None, least: int = 1000, intercept: bool = True, alpha: float = 0.0, l1_ratio: float = 0.15, max_iter: int = 1000, tol: float = 1e-3) -> DataFrame:
    """Fit ``value`` on ``variables`` in each slice and predict wherever the variables are finite: all columns and ``model``.

    Rows count for the fit if value, variables and weight are finite; a slice with fewer than ``least`` of them gets NULL.
    Variables are standardised in each slice. ``alpha`` > 0 fits an elastic net (on the same sums, so it is exact at its
    optimum). The fit of a slice is over all its rows, however they are partitioned: one aggregation of means and
    covariances, which tasks add up before anything is shuffled. The coefficients, a row for each slice, go back to the data
    in a broadcast if they are few, so that the data never move.
    """
    spark = data.sparkSession
    shared.ship(spark)
    usable = finite(value)
    for v in [*variables, *([weight] if weight else [])]:
        usable = usable & finite(v)
    k, columns = len(variables), [*(F.col(v).cast("double") for v in variables), F.col(value).cast("double")]
    if weight:  # sums of products around the whole table's means, which one pass finds
        centre = [x or 0.0 for x in data.filter(usable).agg(*(F.avg(c) for c in columns)).first()]
        z, w = [c - x for c, x in zip(columns, centre, strict=True)], F.col(weight).cast("double")
        total = F.sum(w)
        mean = [F.sum(w * x) / total for x in z]
        pairs = {(i, j): F.sum(w * z[i] * z[j]) / total - mean[i] * mean[j] for i in range(k + 1) for j in range(i, k + 1)}
        mean = [m + x for m, x in zip(mean, centre, strict=True)]
    else:
        mean = [F.avg(c) for c in columns]
        pairs = {(i, j): F.covar_pop(columns[i], columns[j]) for i in range(k + 1) for j in range(i, k + 1)}
    own = [F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns[:k])] + [F.stddev_pop(c).alias(f"_s{i}") for i, c in enumerate(columns[:k])]
    found = data.filter(usable).groupBy(*keys).agg(F.count("*").alias("_n"), *own, *(m.alias(f"_a{i}") for i, m in enumerate(mean)), *(c.alias(f"_c{i}_{j}") for (i, j), c in pairs.items())).filter(F.col("_n") >= least)
    #: shift and scale of each variable; the value keeps both
    low = [F.col(f"_m{i}") if intercept else F.lit(0.0) for i in range(k)] + [F.lit(0.0)]
    unit = [F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}")).otherwise(1.0) if intercept else F.lit(1.0) for i in range(k)] + [F.lit(1.0)]
    middle = [(F.col(f"_a{i}") - low[i]) for i in range(k + 1)]
    terms = [[(F.col(f"_c{i}_{j}") + middle[i] * middle[j]) / (unit[i] * unit[j]) for j in range(i, k + 1)] for i in range(k + 1)]
    first = [F.lit(1.0), *(middle[i] / unit[i] for i in range(k + 1))] if intercept else []
    size = k + 1 if intercept else k
    solve = _solver(size, alpha * l1_ratio, alpha * (1 - l1_ratio), max_iter, tol)
    upper = [*first, *(x for row in terms for x in row)]
    fit = found.select(*keys, *(x.alias(f"_l{i}") for i, x in enumerate(low[:k])), *(x.alias(f"_u{i}") for i, x in enumerate(unit[:k])), solve(F.array(*upper)).alias("_c"))
    fit = shared.materialise(fit, "coefficients")
    if not keys or fit.count() <= MOST_SLICES:
        fit = F.broadcast(fit)
    out = data.join(fit, keys, "left") if keys else data.join(fit, F.lit(True), "left")
    scaled = [(F.col(v) - F.col(f"_l{i}")) / F.col(f"_u{i}") for i, v in enumerate(variables)]
    there = F.lit(True)
    for v in variables:
        there = there & finite(v)
    at = 1 if intercept else 0
    model = sum((F.col("_c")[i + at] * x for i, x in enumerate(scaled)), F.col("_c")[0] if intercept else F.lit(0.0))
    return out.select(*data.columns, F.when(there, model).alias("model"))


def regression_linear(data: DataFrame, value: str, variables: list[str], keys: list[str], weight: str | None = None, least: int = 1000, intercept: bool = True) -> DataFrame:
    return regression(data, value, variables, keys, weight, least, intercept)


def regression_sgd(data: DataFrame, value: str, variables: list[str], keys: list[str], weight: str | None = None, least: int = 1000, max_iter: int = 1000, tol: float = 1e-3, alpha: float = 1e-4, l1_ratio: float = 0.15) -> DataFrame:
    """The elastic-net objective that stochastic descent approaches, solved on the sums."""
    return regression(data, value, variables, keys, weight, least, True, alpha, l1_ratio, max_iter, tol)


def polynomial(rows: DataFrame, by: list[str], t: Column, v: Column, degree: int) -> DataFrame:
    """``by`` and ``coef`` (array, constant first) of a polynomial in ``t``; NULL values don't count."""
    if degree == 0:
        return rows.groupBy(*by).agg(F.array(F.avg(v)).alias("coef"))
    if degree == 1:
        return rows.groupBy(*by).agg(F.array(F.regr_intercept(v, t), F.regr_slope(v, t)).alias("coef"))
    shared.ship(rows.sparkSession)
    centre = rows.agg(F.avg(t)).first()[0] or 0.0  # powers of numbers around 0 keep the sums well conditioned
    good = rows.select(*by, ((t - centre) / YEAR).alias("_t"), v.cast("double").alias("_v")).filter("_t IS NOT NULL AND _v IS NOT NULL")
    one = [F.pow(F.col("_t"), F.lit(k)) for k in range(degree + 1)] + [F.col("_v")]
    sums = [F.sum(one[i] * one[j]) for i in range(degree + 2) for j in range(i, degree + 2)]
    fit = good.groupBy(*by).agg(F.array(*sums).alias("g")).select(*by, _solver(degree + 1)("g").alias("c"))
    # c_k ((t - centre) / year)^k as powers of t
    terms = [sum((F.col("c")[k] * (math.comb(k, j) * (-centre) ** (k - j) / YEAR**k) for k in range(j + 1, degree + 1)), F.col("c")[j] / YEAR**j) for j in range(degree + 1)]
    return fit.select(*by, F.array(*terms).alias("coef"))


def _by_pixel(data: DataFrame, value: Column, weight: str | None, pairs: DataFrame | None, model) -> DataFrame:
    """``ref, rep, y, x, v`` of the pairs a pixel has, from ``model(values, weights, pairs, there)`` of many pixels' values.

    A pixel's pairs are packed into one row, one shuffle, in which all their roles are played.
    """
    shared.ship(data.sparkSession)
    known = network(data if pairs is None else pairs)[0]
    rows = packed(data.withColumn("_value", value), known, "_value", weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = b.column(2)
            v, w = dense(s, len(known), "v", "w")
            row = np.repeat(np.arange(len(s)), np.asarray(pa.compute.list_value_length(s), np.int64))
            there = np.zeros(v.shape, bool)
            there[row, np.asarray(s.flatten().field("k"), np.int64)] = True
            got, found = model(v, w, known, there)
            place, k = np.nonzero(there & found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([known[i][0] for i in k.tolist()], pa.date32()), pa.array([known[i][1] for i in k.tolist()], pa.date32()), b.column(0).take(pa.array(place)), b.column(1).take(pa.array(place)), pa.array(got[place, k], from_pandas=True)], names=["ref", "rep", "y", "x", "v"]
            )

    y, x = (data.schema[c].dataType.simpleString() for c in "yx")
    return rows.mapInArrow(run, f"ref date, rep date, y {y}, x {x}, v double")


def _touching(known: list) -> tuple[list, np.ndarray, np.ndarray]:
    """The dates of pairs, and for each (pair, date) the sign of its role there (0: none) and its signed days."""
    dates = sorted({d for p in known for d in p})
    sign = np.array([[1.0 if d == a else -1.0 if d == b else 0.0 for d in dates] for a, b in known]).reshape(len(known), len(dates))
    return dates, sign, sign * np.array([(b - a).days for a, b in known], float)[:, None]


def _between(known: list, dates: list, at_date: np.ndarray, have: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair's model at ref minus that at rep, and whether both dates have one at the pixel."""
    number = {d: i for i, d in enumerate(dates)}
    i, j = ([number[p[e]] for p in known] for e in (0, 1))
    return at_date[:, i] - at_date[:, j], have[:, i] & have[:, j]


def pair_polynomial(data: DataFrame, value: str, degree: int = 0, weight: str | None = None, max_days: int | None = None, count: int | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Per date and pixel a polynomial in days over the pairs that touch the date (values and days signed by their direction);
    the highest coefficient is the date's model, and a pair's model is model[ref] - model[rep].

    ``count`` nearest pairs in time, then those within ``max_days``. A weight multiplies values by its root. ``pairs``: the
    network, which spares a pass over the data to find it.
    """

    def model(v: np.ndarray, w: np.ndarray, known: list, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dates, sign, days_ = _touching(known)
        used = sign != 0
        if count is not None:
            for d in range(len(dates)):
                near = sorted(np.flatnonzero(used[:, d]).tolist(), key=lambda k: (abs(days_[k, d]), known[k]))
                used[near[count:], d] = False
        if max_days is not None:
            used &= np.abs(days_) <= max_days
        value_ = v * np.sqrt(w) if weight else v
        out, have = np.full((len(v), len(dates)), np.nan), np.zeros((len(v), len(dates)), bool)
        for d in range(len(dates)):
            k = np.flatnonzero(used[:, d])
            t, z = days_[k, d] / YEAR, value_[:, k] * sign[k, d]
            ok = ~np.isnan(z)
            have[:, d] = there[:, k].any(1)
            powers = t[None, :] ** np.arange(degree + 1)[:, None]  # degree, pair
            a = np.einsum("np,ip,jp->nij", ok.astype(float), powers, powers)
            b = np.where(ok, z, 0.0) @ powers.T
            kinds, kind = np.unique(ok, axis=0, return_inverse=True)
            solvable = np.array([len(np.unique(t[x])) > degree for x in kinds], bool)[kind.reshape(-1)]
            if not solvable.any():
                continue
            out[solvable, d] = np.linalg.solve(a[solvable], b[solvable][..., None])[:, degree, 0] / YEAR**degree
        return _between(known, dates, out, have)

    return _by_pixel(data, F.col(value), weight, pairs, model).withColumnRenamed("v", value)


def turbulence(data: DataFrame, value: str = "phase", weight: str | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Per date the (weighted) mean of its pairs' phases signed by role; a pair's part is t[ref] - t[rep].

    ``pairs``: the network, which spares a pass over the data to find it.
    """

    def model(v: np.ndarray, w: np.ndarray, known: list, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dates, sign, _ = _touching(known)
        role = (sign != 0).astype(float)
        part = np.where(np.isnan(w) | ~there, 0.0, w) if weight else (there & ~np.isnan(v)).astype(float)
        top = np.where(np.isnan(v) | np.isnan(w), 0.0, v * part) @ sign
        below = part @ role
        with np.errstate(invalid="ignore", divide="ignore"):
            return _between(known, dates, np.where(below != 0, top / below, np.nan), (there.astype(float) @ role) > 0)

    return _by_pixel(data, F.col(value), weight, pairs, model).withColumnRenamed("v", value)


def velocity(stack: DataFrame, value: str = "displacement") -> DataFrame:
    """Least-squares slope over dates, per year, of each pixel."""
    return stack.groupBy("y", "x").agg((F.regr_slope(value, days("date")) * YEAR).alias("velocity"))


def trend(stack: DataFrame, value: str, degree: int = 1, abscissa: Column | None = None, keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """A polynomial along dates (or a given abscissa) for each pixel: its values as ``trend`` and its coefficients."""
    t = abscissa if abscissa is not None else days("date")
    if degree == 1:
        w = Window.partitionBy("y", "x")
        slope, start = F.regr_slope(F.col(value), t).over(w), F.regr_intercept(F.col(value), t).over(w)
        return stack.select(*keys, "y", "x", F.array(start, slope).alias("coef"), t.alias("_t")).select(*keys, "y", "x", (F.col("coef")[0] + F.col("coef")[1] * F.col("_t")).alias("trend"), "coef")
    fit = polynomial(stack, ["y", "x"], t, F.col(value), degree)
    powers = F.aggregate(F.transform("coef", lambda c, i: c * F.pow(F.col("_t"), i)), F.lit(0.0), lambda a, b: a + b)
    return stack.select(*keys, "y", "x", t.alias("_t")).join(fit, ["y", "x"]).select(*keys, "y", "x", powers.alias("trend"), "coef")


# ---- robust planes


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    f = c = 1.0
    d = 0.0
    for i in range(500):
        m = i // 2
        term = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d) if abs(1 + term * d) > 1e-30 else 1e30
        c = 1 + term / c if abs(c) > 1e-30 else 1e30
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (f - 1)


def robust_plane(points: DataFrame, rank: int = 3, x: str = "x", y: str = "y", z: str = "z") -> tuple[list[float], tuple[float, float, float, float]]:
    """Coefficients of a plane through points by re-weighting, x and y scaled to [-1, 1], and the ranges of x and y.

    Each round is one aggregation for the fit, one for chi square and a few for the exact median, of which no task holds all
    residuals; only these numbers reach the driver.
    Weights are 1 up to k = 1.5 * 1.4826 * median residual and 2k/r - k2/r2 beyond; rounds end when an F test finds the
    change insignificant (< 0.51), and the best chi square wins.
    """
    if rank not in (1, 2, 3):
        raise ValueError("rank is 1, 2 or 3")
    n, x0, x1, y0, y1 = points.agg(F.count("*"), F.min(x), F.max(x), F.min(y), F.max(y)).first()
    unit = lambda c, a, b: (2 * (F.col(c) - a) / (b - a) - 1) if b > a else F.lit(0.0)
    terms = [F.lit(1.0), unit(x, x0, x1), unit(y, y0, y1)][:rank]
    everything = [*terms, F.col(z)]
    w, old, best = F.lit(1.0), None, None
    while True:
        sums = points.agg(*(F.sum(w * everything[i] * everything[j]) for i in range(rank + 1) for j in range(i, rank + 1))).first()
        g = np.zeros((rank + 1, rank + 1))
        g[np.triu_indices(rank + 1)] = sums
        g = g + np.triu(g, 1).T
        coef = np.linalg.lstsq(g[:rank, :rank], g[:rank, rank], rcond=None)[0].tolist()
        r = F.abs(F.col(z) - sum((F.lit(c) * t for c, t in zip(coef[1:], terms[1:], strict=True)), F.lit(coef[0])))
        square, middle = points.agg(F.sum(r * r * w) / (n - 3)).first()[0], stats.quantiles(points.select(r.alias("r")), "r", [0.5]).first()[0]
        k = 1.5 * 1.4826 * middle
        if old is None or old > square:
            best = coef
        significant = 1.0 if old is None else 1.0 if square == 0 else 0.0 if old == 0 else incomplete_beta(0.5 * (n - 3), 0.5 * (n - 3), old / (old + square))
        if significant < 0.51 or square == 0:
            return best, (x0, x1, y0, y1)
        old, w = square, F.when(r <= k, 1.0).otherwise(2 * k / r - k * k / (r * r))


def fit_offsets(offsets: DataFrame, rank_range: int, rank_azimuth: int, snr: float = 20) -> dict[str, float]:
    """Shift and stretch parameters from offsets (columns range, d_range, azimuth, d_azimuth, snr) over a signal-to-noise limit."""
    good = shared.materialise(offsets.filter(F.col("snr") > snr), "offsets")  # read once for each round of two fits
    n = good.count()
    if n < 8:
        raise ValueError(f"{n} points are over the limit; 8 are needed")
    rng, (x0, x1, y0, y1) = robust_plane(good.select(F.col("range").alias("x"), F.col("azimuth").alias("y"), F.col("d_range").alias("z")), rank_range)
    azi, _ = robust_plane(good.select(F.col("range").alias("x"), F.col("azimuth").alias("y"), F.col("d_azimuth").alias("z")), rank_azimuth)
    shared.drop_table(offsets.sparkSession, good)
    out = {}
    for name, sub, coef in (("r", "r", rng), ("a", "a", azi)):
        c = [*coef, 0.0, 0.0][:3]
        shift = c[0] - c[1] * (x1 + x0) / (x1 - x0) - c[2] * (y1 + y0) / (y1 - y0)
        whole = math.floor(shift) if shift >= 0 else int(shift) - 1
        part = math.fmod(shift, 1) + (0 if shift >= 0 else 1)
        out |= {f"{name}shift": whole, f"sub_int_{sub}": part, f"stretch_{name}": 2 * c[1] / (x1 - x0), f"a_stretch_{name}": 2 * c[2] / (y1 - y0)}
    return out
