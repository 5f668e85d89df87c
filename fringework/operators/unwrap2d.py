"""Two-dimensional unwrapping of each pair's phase.

Each tile is unwrapped by weighted least squares (conjugate gradients preconditioned by cosine transforms), snapped to the
wrapped phase's congruent surface; tiles of a slice are then brought together by whole turns, from the median differences
along their shared borders. Only those differences, a few numbers for each tile, meet in one place for a slice.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringework import shared
from fringework.operators import raster
from fringework.operators.raster import Grid


@dataclass
class Config:
    """Settings; what isn't a field of its own goes to ``more`` and into the text form."""

    defomax: float = 0.0
    rounds: int = 100
    tolerance: float = 1e-4
    tile: int = 512
    more: dict = field(default_factory=dict)

    def text(self) -> str:
        say = lambda v: ("TRUE" if v else "FALSE") if isinstance(v, bool) else v
        return "".join(f"{k} {say(v)}\n" for k, v in {"DEFOMAX_CYCLE": self.defomax, **self.more}.items())


def _dct_basis(n: int) -> np.ndarray:
    k, i = np.arange(n)[:, None], np.arange(n)[None]
    b = np.cos(np.pi * k * (2 * i + 1) / (2 * n)) * np.sqrt(2 / n)
    b[0] /= np.sqrt(2)
    return b


def _wrapped(v: np.ndarray) -> np.ndarray:
    return (v + np.pi) % (2 * np.pi) - np.pi


def unwrap_tile(phase: np.ndarray, weight: np.ndarray, config: Config) -> np.ndarray:
    """Unwrapped phase of one dense array; NaN cells have weight 0 and stay NaN."""
    ny, nx = phase.shape
    gone = np.isnan(phase)
    if gone.all():
        return np.full(phase.shape, np.nan)
    p, w = np.where(gone, 0.0, phase), np.where(gone, 0.0, np.maximum(np.nan_to_num(weight), 1e-3))
    wy, wx = np.minimum(w[1:], w[:-1]) ** 2, np.minimum(w[:, 1:], w[:, :-1]) ** 2

    def apply(dy: np.ndarray, dx: np.ndarray) -> np.ndarray:
        out = np.zeros((ny, nx))
        out[:-1] += dy
        out[1:] -= dy
        out[:, :-1] += dx
        out[:, 1:] -= dx
        return out

    b = apply(wy * _wrapped(np.diff(p, axis=0)), wx * _wrapped(np.diff(p, axis=1)))
    cy, cx = _dct_basis(ny), _dct_basis(nx)
    poles = (2 * np.cos(np.pi * np.arange(ny) / ny) - 2)[:, None] + (2 * np.cos(np.pi * np.arange(nx) / nx) - 2)[None]
    poles[0, 0] = 1

    def solve(r: np.ndarray) -> np.ndarray:
        s = cy @ r @ cx.T / poles
        s[0, 0] = 0
        return cy.T @ s @ cx

    x, r = np.zeros((ny, nx)), b.copy()
    d, old, first = None, 0.0, np.sqrt((b * b).sum())
    for _ in range(config.rounds):
        if np.sqrt((r * r).sum()) <= config.tolerance * first or first == 0:
            break
        z = solve(r)
        rz = (r * z).sum()
        d = z if d is None else z + rz / old * d
        old = rz
        q = apply(wy * np.diff(d, axis=0), wx * np.diff(d, axis=1))
        step = rz / (d * q).sum()
        x, r = x + step * d, r - step * q
    shift = np.angle(np.exp(1j * (x - p)[~gone]).mean())  # the solution is free by a constant
    k = np.round((x - p - shift) / (2 * np.pi))
    return np.where(gone, np.nan, p + 2 * np.pi * k)


def align(edges: pd.DataFrame) -> dict[tuple[int, int], int]:
    """Whole turns of each tile from rows (ty, tx, ty2, tx2, turns, n): the strongest borders first, each tile once."""
    turns: dict[tuple[int, int], int] = {}
    group: dict[tuple[int, int], set] = {}
    for t in {*zip(edges.ty, edges.tx, strict=True), *zip(edges.ty2, edges.tx2, strict=True)}:
        turns[t], group[t] = 0, {t}
    for r in edges.sort_values(["n", "ty", "tx", "ty2", "tx2"], ascending=[False, True, True, True, True]).itertuples():
        a, b = (r.ty, r.tx), (r.ty2, r.tx2)
        if group[a] is group[b]:
            continue
        shift = turns[a] + r.turns - turns[b]
        for t in group[b]:
            turns[t] += shift
        group[a] |= group[b]
        for t in group[b]:
            group[t] = group[a]
    return turns


def unwrap2d(data: DataFrame, value: str = "phase", weight: str | None = "correlation", config: Config | None = None, components: bool = False) -> DataFrame:
    """Unwrapped ``value`` of each pair's grid: ``pair, ref, rep, y, x, value[, conncomp]``; missing cells stay missing.

    ``components`` adds the number of the 4-neighbour component of cells with a value, 1 for the largest.
    """
    config = config or Config()
    shared.ship(data.sparkSession)
    keys = ["pair", "ref", "rep"]
    g = Grid.of(data)
    rows = data.withColumn("_w", F.col(weight).cast("double") if weight else F.lit(1.0))

    def kernel(arrays: list[np.ndarray], y0: int, x0: int) -> list[np.ndarray]:
        return [unwrap_tile(arrays[0], arrays[1], config)]

    tile = config.tile
    alone = shared.materialise(raster.on_tiles(rows, keys, [value, "_w"], [value], kernel, 0, g, tile).filter(f"{value} IS NOT NULL"), "tiles")
    cells = alone.select(*keys, g.iy().alias("iy"), g.ix().alias("ix"), F.col(value).alias("v"))
    cells = cells.withColumn("ty", F.floor(F.col("iy") / tile).cast("int")).withColumn("tx", F.floor(F.col("ix") / tile).cast("int"))
    found = None
    for a, b in (("iy", "ix"), ("ix", "iy")):
        end = cells.filter(F.pmod(F.col(a), F.lit(tile)) == tile - 1).withColumn(a, F.col(a) + 1)
        start = cells.filter(F.pmod(F.col(a), F.lit(tile)) == 0).select(*keys, "iy", "ix", F.col("v").alias("v2"), F.col("ty").alias("ty2"), F.col("tx").alias("tx2"))
        met = end.join(start, [*keys, "iy", "ix"]).groupBy(*keys, "ty", "tx", "ty2", "tx2").agg(F.round(F.median((F.col("v") - F.col("v2")) / (2 * math.pi))).cast("int").alias("turns"), F.count("*").alias("n"))
        found = met if found is None else found.unionByName(met)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        t = align(pdf)
        first = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame([first | {"ty": a, "tx": b, "k": k} for (a, b), k in t.items()], columns=[*keys, "ty", "tx", "k"])

    kinds = ", ".join(f"{k} {data.schema[k].dataType.simpleString()}" for k in keys)
    turns = found.groupBy(*keys).applyInPandas(whole, f"{kinds}, ty int, tx int, k int")
    out = cells.join(turns, [*keys, "ty", "tx"], "left").select(*keys, g.y(F.col("iy")).alias("y"), g.x(F.col("ix")).alias("x"), (F.col("v") + 2 * math.pi * F.coalesce("k", F.lit(0))).alias(value))
    out = data.select(*keys, "y", "x").join(out, [*keys, "y", "x"], "left")
    if components:
        from pyspark.sql import Window

        labels = raster.label(out.withColumn("mask", F.col(value).isNotNull()), "mask", keys, g)
        sizes = labels.groupBy(*keys, "label").agg(F.count("*").alias("n"))
        order = sizes.withColumn("conncomp", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "label"))).drop("n")
        out = out.join(labels.join(order, [*keys, "label"]).drop("label"), [*keys, "y", "x"], "left").withColumn("conncomp", F.coalesce("conncomp", F.lit(0)))
    return out
