"""Seasonal-trend decomposition by local regression of each pixel's regularised series, on arrays of many pixels at once.

Without robustness weights every smoothing step is a fixed matrix, so a batch of series is a few matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringework import shared
from fringework.operators.inversion import dense, spread


def weekly(first: date, last: date, freq: str = "W") -> list[date]:
    """Regular dates from ``first`` to ``last``: ``W`` Sundays, ``D`` days, ``nD`` every n days."""
    if freq == "W":
        start, step = first + timedelta((6 - first.weekday()) % 7), 7
    elif freq.endswith("D"):
        start, step = first, int(freq[:-1] or 1)
    else:
        raise ValueError(f"freq is W, D or nD, not {freq}")
    return [start + timedelta(k) for k in range(0, (last - start).days + 1, step)]


def regular_dates(dates: DataFrame, freq: str = "W") -> DataFrame:
    """The same regular dates as a table, from a table of dates."""
    ends = dates.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    if freq == "W":
        sunday = F.next_day(F.date_sub("a", 1), "Sun")
        return ends.select(F.explode(F.when(sunday <= F.col("b"), F.sequence(sunday, F.col("b"), F.expr("interval 7 days"))).otherwise(F.array())).alias("date"))
    n = int(freq[:-1] or 1)
    return ends.select(F.explode(F.sequence("a", "b", F.expr(f"interval {n} days"))).alias("date"))


def loess_row(n: int, q: int, at: float, left: int, right: int, robust: np.ndarray | None = None) -> np.ndarray:
    """Weights by which a degree-1 local regression at place ``at`` (from 1) uses the points left..right of n; zeros if it has none."""
    out = np.zeros(n)
    h = max(at - left, right - at)
    if q > n:
        h += (q - n) // 2
    j = np.arange(left, right + 1)
    r = np.abs(j - at)
    w = np.where(r <= 0.999 * h, np.where(r > 0.001 * h, (1 - (r / h if h else r) ** 3) ** 3, 1.0), 0.0)
    if robust is not None:
        w = w * robust[left - 1 : right]
    total = w.sum()
    if total <= 0:
        return out
    w = w / total
    if h > 0:
        a = (w * j).sum()
        b, c = at - a, (w * (j - a) ** 2).sum()
        if np.sqrt(c) > 0.001 * (n - 1):
            w = w * (b / c * (j - a) + 1)
    out[left - 1 : right] = w
    return out


def loess_matrix(n: int, q: int, robust: np.ndarray | None = None) -> np.ndarray:
    """Smoothing of n equally spaced points by windows of q."""
    rows, left, right, half = [], 1, min(q, n), (q + 1) // 2
    for i in range(1, n + 1):
        if q < n and i > half and right != n:
            left, right = left + 1, right + 1
        row = loess_row(n, q, i, left, right, robust)
        if not row.any():
            row[i - 1] = 1
        rows.append(row)
    return np.array(rows)


def _seasonal_matrix(n: int, period: int, q: int, robust: np.ndarray | None = None) -> np.ndarray:
    """From n values to n + 2 period smoothed values of the cycle's subseries, each with a step more at both ends."""
    out = np.zeros((n + 2 * period, n))
    for p in range(period):
        own = np.arange(p, n, period)
        k = len(own)
        if not k:
            continue
        rb = None if robust is None else robust[own]
        inner = loess_matrix(k, q, rb)
        first = loess_row(k, q, 0, 1, min(q, k), rb)
        last = loess_row(k, q, k + 1, max(1, k - q + 1), k, rb)
        for row, source in ((first, inner[0]), (last, inner[-1])):
            if not row.any():
                row[:] = source
        out[p :: period][: k + 2, own] = np.vstack([first, inner, last])
    return out


def _mean_matrix(n: int, q: int) -> np.ndarray:
    out = np.zeros((n - q + 1, n))
    for i in range(n - q + 1):
        out[i, i : i + q] = 1 / q
    return out


def _odd(n: int) -> int:
    return n if n % 2 else n + 1


class Stl:
    """Decomposition of series of length n; ``period`` >= 2 and two whole periods are needed."""

    def __init__(self, n: int, period: int = 52, seasonal: int = 7, robust: bool = False):
        if period < 2 or n < 2 * period:
            raise ValueError("a series needs two whole periods of at least 2")
        self.n, self.period, self.seasonal, self.robust = n, period, seasonal, robust
        self.trend_q = _odd(int(np.ceil(1.5 * period / (1 - 1.5 / seasonal))))
        self.low_q = _odd(period + 1)
        wide = n + 2 * period
        means = _mean_matrix(wide - 2 * period + 2, 3) @ _mean_matrix(wide - period + 1, period) @ _mean_matrix(wide, period)
        self.means, self.low = means, loess_matrix(n, self.low_q)

    def _inner(self, y: np.ndarray, rounds: int, trend: np.ndarray, robust: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        c = _seasonal_matrix(self.n, self.period, self.seasonal, robust)
        s = c[self.period : self.period + self.n] - self.low @ self.means @ c
        t = loess_matrix(self.n, self.trend_q, robust)
        season = np.zeros_like(y)
        for _ in range(rounds):
            season = (y - trend) @ s.T
            trend = (y - season) @ t.T
        return season, trend

    def __call__(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Trend, seasonal part and rest of each row; a row with a NaN gives NaN."""
        out = [np.full(y.shape, np.nan) for _ in range(3)]
        rows = np.flatnonzero(~np.isnan(y).any(1))
        if not len(rows):
            return tuple(out)
        if not self.robust:
            season, trend = self._inner(y[rows], 5, np.zeros((len(rows), self.n)), None)
            out[0][rows], out[1][rows] = trend, season
        else:
            for i in rows:
                one, weight = y[i : i + 1], None
                trend = np.zeros((1, self.n))
                for _ in range(16):
                    season, trend = self._inner(one, 2, trend, weight)
                    r = np.abs(one - season - trend)[0]
                    h = 6 * np.median(r)
                    u = r / h if h > 0 else np.zeros(self.n)
                    weight = np.where(r <= 0.999 * h, np.where(r > 0.001 * h, (1 - u**2) ** 2, 1.0), 0.0) if h > 0 else None
                out[0][i], out[1][i] = trend[0], season[0]
        out[2] = y - out[0] - out[1]
        return tuple(out)


def nearest_index(dates: list[date], regular: list[date]) -> np.ndarray:
    """For each regular date the nearest of ``dates`` (ascending); of equal ones the earlier."""
    a = np.array([d.toordinal() for d in dates])
    b = np.array([d.toordinal() for d in regular])
    middle = (a[1:] + a[:-1]) / 2
    return np.searchsorted(middle, b, side="left")


def stl(stack: DataFrame, value: str = "displacement", freq: str = "W", period: int = 52, robust: bool = False, dates: list[date] | None = None) -> DataFrame:
    """``date (regular), y, x, trend, seasonal, resid`` from ``date, y, x, value``; a pixel with a missing date gives NULLs.

    A pixel's dates are packed into one row, as many as the stack has dates. ``dates``: those of the stack, which spares a
    pass over it to find them.
    """
    spark = stack.sparkSession
    shared.ship(spark)
    days = stack.withColumn("date", F.col("date").cast("date"))
    known = sorted(dates) if dates is not None else sorted(r.date for r in days.select("date").distinct().collect())  # one for each scene
    regular = weekly(known[0], known[-1], freq) if known else []
    pick = nearest_index(known, regular) if known else np.zeros(0, int)
    number = F.broadcast(spark.createDataFrame(list(zip(known, range(len(known)), strict=True)), "date date, k int"))
    rows = days.join(number, "date").groupBy("y", "x").agg(F.collect_list(F.struct("k", F.col(value).cast("double").alias("v"))).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Stl(len(regular), period, robust=robust)
        for b in batches:
            (v,) = dense(b.column(2), len(known), "v")
            found = model(np.where(np.isnan(v).any(1)[:, None], np.nan, v)[:, pick])
            yield spread(b, {"date": regular}, {k: pa.array(a.reshape(-1), from_pandas=True) for k, a in zip(("trend", "seasonal", "resid"), found, strict=True)})

    y, x = (stack.schema[c].dataType.simpleString() for c in "yx")
    return rows.mapInArrow(run, f"date date, y {y}, x {x}, trend double, seasonal double, resid double")
