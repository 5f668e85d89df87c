"""Per-pixel inversion of pair networks: least-squares displacement histories and temporal unwrapping.

A pixel's pairs are packed into one row (their number is that of the network, not of the data), NumPy works on batches of
pixels, and dates come back as rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fringework import shared
from fringework.operators.pairs import dates_of, pair_name


def network(pairs: DataFrame) -> tuple[list, list, np.ndarray]:
    """Pairs and dates in order and the matrix with 1 for dates in (ref, rep]. One row for each pair reaches the driver."""
    p = sorted((r.ref, r.rep) for r in pairs.select(F.col("ref").cast("date").alias("ref"), F.col("rep").cast("date").alias("rep")).distinct().collect())
    d = sorted({x for r in p for x in r})
    m = np.array([[1.0 if a < x <= b else 0.0 for x in d] for a, b in p]).reshape(len(p), len(d))
    return p, d, m


def packed(data: DataFrame, pairs: list, value: str, weight: str | None) -> DataFrame:
    """One row for each pixel: ``y, x, s`` with s an array of (pair number, value, weight)."""
    spark = data.sparkSession
    number = F.broadcast(spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "ref date, rep date, k int"))  # as many rows as the network
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = data.select(F.col("ref").cast("date").alias("ref"), F.col("rep").cast("date").alias("rep"), "y", "x", F.col(value).cast("double").alias("v"), w.alias("w")).join(number, ["ref", "rep"])
    return rows.groupBy("y", "x").agg(F.collect_list(F.struct("k", "v", "w")).alias("s"))


def dense(s: pa.ListArray, n: int, *fields: str) -> list[np.ndarray]:
    """Matrices [row, k] of the named fields of lists of structs with a number ``k`` under n; NaN where there is none."""
    flat = s.flatten()
    row = np.repeat(np.arange(len(s)), np.asarray(pa.compute.fill_null(pa.compute.list_value_length(s), 0), np.int64))
    k, out = np.asarray(flat.field("k"), np.int64), []
    for f in fields:
        a = np.full((len(s), n), np.nan)
        a[row, k] = flat.field(f).to_numpy(zero_copy_only=False)
        out.append(a)
    return out


def spread(b: pa.RecordBatch, names: dict[str, list], values: dict[str, pa.Array]) -> pa.RecordBatch:
    """A row of ``y, x`` for each of its pixels and each of the names' entries, next to the values (row by row)."""
    n = len(next(iter(names.values())))
    each = pa.array(np.repeat(np.arange(b.num_rows), n))
    cols = {k: pa.array(v).take(pa.array(np.tile(np.arange(n), b.num_rows))) for k, v in names.items()}
    cols |= {c: b.column(c).take(each) for c in ("y", "x")} | values
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def solve(v: np.ndarray, w: np.ndarray | None, m: np.ndarray, cumulative: bool = True) -> np.ndarray:
    """Minimum-norm weighted least squares of each row; missing observations count nothing; all missing gives NaN.

    Without weights rows with the same observations missing share one inverse.
    """
    gone = np.isnan(v) if w is None else np.isnan(v) | np.isnan(w)
    out, limit = np.full((len(v), m.shape[1]), np.nan), np.finfo(float).eps * max(m.shape)
    known = np.where(gone, 0.0, v)
    if w is None:
        kinds, kind = np.unique(gone, axis=0, return_inverse=True)
        for i, lost in enumerate(kinds):
            rows = np.flatnonzero(kind.reshape(-1) == i)
            if not lost.all():
                out[rows] = known[rows] @ np.linalg.pinv(np.where(lost[:, None], 0.0, m), rcond=limit).T
        return np.cumsum(out, 1) if cumulative else out
    q = np.where(gone, 0.0, np.minimum(w, 1.0)) * (1 - 1e-6)
    root = q / np.sqrt(1 - q * q)
    rows = np.flatnonzero(~gone.all(1))
    for at in range(0, len(rows), 1024):
        i = rows[at : at + 1024]
        try:
            inverse = np.linalg.pinv(root[i][:, :, None] * m, rcond=limit)
            out[i] = np.einsum("ndp,np->nd", inverse, root[i] * known[i])
        except np.linalg.LinAlgError:
            continue
    return np.cumsum(out, 1) if cumulative else out


def lstsq(data: DataFrame, value: str = "phase", weight: str | None = None, cumulative: bool = True, name: str = "displacement", pairs: DataFrame | None = None) -> DataFrame:
    """``date, y, x, displacement`` from pair values ``ref, rep, y, x, value[, weight]``; weights over 1 count as 1.

    ``pairs``: the network, which spares a pass over the data to find it; values of other pairs are left out.
    """
    shared.ship(data.sparkSession)
    pairs_, dates, m = network(data if pairs is None else pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, w = dense(b.column(2), len(pairs_), "v", "w")
            got = solve(v, w if weight else None, m, cumulative).reshape(-1).astype(np.float32)
            yield spread(b, {"date": dates}, {name: pa.array(got, from_pandas=True)})

    y, x = (data.schema[c].dataType.simpleString() for c in "yx")
    return packed(data, pairs_, value, weight).mapInArrow(run, f"date date, y {y}, x {x}, {name} float")


def closures(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From a network's matrix: which pairs cover one step of its dates, and which of those make up each longer pair (pair, step)."""
    step = m.sum(1) == 1
    return step, (m @ m.T > 0) & step[None, :] & ~step[:, None]


def unwrap(v: np.ndarray, m: np.ndarray, tolerance: float = math.pi / 2) -> np.ndarray:
    """Whole turns on the values of each row (one for each pair, NaN missing), from the closure of each pair with its steps.

    A pair over several dates should equal the sum of the pairs between neighbouring dates that it is made up of. It gets the
    whole turns that bring it nearest to that sum; it is confirmed if then less than ``tolerance`` is left, and so are its
    steps. Pairs that nothing confirms are missing, those some of whose steps aren't observed among them, unless none of the
    row is confirmed: then its values stay as they are. Every pair is judged by itself, so no order matters.
    """
    step, parts = closures(m)
    there = ~np.isnan(v)
    known = np.where(there, v, 0.0)
    need = np.where(step, 0.0, m.sum(1))  # steps of each longer pair
    parts = parts.astype(float)
    total = known @ parts.T
    whole = ((there.astype(float) @ parts.T) == need) & ~step & there
    turns = np.where(whole, np.round((total - known) / (2 * math.pi)), 0.0)
    out = known + 2 * math.pi * turns
    sure = whole & (np.abs(out - total) < tolerance)
    sure |= there & step & ((sure.astype(float) @ parts) > 0)
    return np.where(there & (sure | ~sure.any(1, keepdims=True)), np.where(sure, out, v), np.nan)


def unwrap1d(data: DataFrame, value: str = "phase", weight: str | None = None, tolerance: float = math.pi / 2, pairs: DataFrame | None = None) -> DataFrame:
    """Unwrapped ``value`` of each pair and pixel: ``pair, ref, rep, y, x, value``; see ``unwrap``.

    A missing weight makes an observation missing. ``pairs``: the network, which spares a pass over the data to find it.
    """
    shared.ship(data.sparkSession)
    pairs_, _, m = network(data if pairs is None else pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {"ref": [p[0] for p in pairs_], "rep": [p[1] for p in pairs_]}
        for b in batches:
            v, w = dense(b.column(2), len(pairs_), "v", "w")
            got = unwrap(np.where(np.isnan(w), np.nan, v), m, tolerance).reshape(-1)
            yield spread(b, names, {value: pa.array(got, from_pandas=True)})

    y, x = (data.schema[c].dataType.simpleString() for c in "yx")
    out = packed(data, pairs_, value, weight).mapInArrow(run, f"ref date, rep date, y {y}, x {x}, {value} double")
    return out.select(pair_name().alias("pair"), "ref", "rep", "y", "x", value)


def chain_sums(data: DataFrame, value: str = "phase") -> DataFrame:
    """The history of a chain of consecutive pairs (each date's pair with the next): a running sum, without any solver."""
    w = Window.partitionBy("y", "x").orderBy("rep").rowsBetween(Window.unboundedPreceding, 0)
    steps = data.select(F.col("rep").alias("date"), "y", "x", F.sum(value).over(w).alias("displacement"))
    first = data.groupBy("y", "x").agg(F.min("ref").alias("date")).select("date", "y", "x", F.lit(0.0).alias("displacement"))
    return first.unionByName(steps)


__all__ = ["chain_sums", "closures", "dates_of", "dense", "lstsq", "network", "packed", "solve", "spread", "unwrap", "unwrap1d"]
