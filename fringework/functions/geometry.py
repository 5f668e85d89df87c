"""Radar geometry on plain numbers or arrays: pixel spacing, decimation factors, baselines, kernels."""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np

from fringework.functions.columns import SPEED_OF_LIGHT


def pixel_spacing(p: Mapping[str, float], grid: tuple[float, float] | float = 1) -> tuple[float, float]:
    """Ground size (azimuth, range) in metres of a pixel of ``grid`` decimation."""
    dy, dx = grid if isinstance(grid, tuple) else (grid, grid)
    radius, height = p["earth_radius"], p["SC_height"]
    azimuth = p["SC_vel"] / math.sqrt(1 + height / radius) / p["PRF"]
    slant = SPEED_OF_LIGHT / p["rng_samp_rate"] / 2
    centre = radius + height
    middle = p["near_range"] + slant * p["num_rng_bins"] / 2
    look = math.acos((centre**2 + middle**2 - radius**2) / (2 * centre * middle))
    bend = math.acos((centre**2 + radius**2 - middle**2) / (2 * centre * radius))
    return dy * azimuth, dx * slant / math.sin(look + bend)


def coarsen_factors(factor: tuple | float, spacing: tuple[float, float]) -> tuple[int, int]:
    """Whole numbers are factors; floats are metres, turned into factors by the spacing (a range factor over 4 is a multiple of 4)."""
    y, x = factor if isinstance(factor, tuple | list) else (factor, factor)
    if isinstance(y, bool) or isinstance(x, bool) or type(y) is not type(x):
        raise TypeError("both factors must be whole numbers, or both metres")
    if isinstance(y, int):
        return y, x
    fy, fx = max(1, round(y / spacing[0])), max(1, round(x / spacing[1]))
    return fy, 4 * max(1, round(fx / 4)) if fx > 4 else fx


def decimation(resolution: float, spacing: tuple[float, float], grid: tuple[float, float] = (1, 4)) -> tuple[int, int]:
    """Block sizes (azimuth, range) that bring pixels of ``spacing`` to ``resolution``; range starts from 4 or 2 on full grids."""
    first = 4 if grid == (1, 1) else 2 if grid == (1, 2) else 1
    return max(1, round(resolution / spacing[0])), max(1, first * round(resolution / spacing[1] / first))


def gaussian_1d(sigma: float, truncate: float = 4.0) -> np.ndarray:
    if sigma <= 0:
        return np.ones(1)
    reach = int(truncate * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return k / k.sum()


def gaussian_kernel(size: tuple[int, int] = (5, 5), std: tuple[float, float] = (1, 1)) -> np.ndarray:
    """Outer product of two Gaussians with peak 1."""
    one = [np.exp(-0.5 * ((np.arange(n) - (n - 1) / 2) / s) ** 2) for n, s in zip(size, std, strict=True)]
    return np.outer(*one)


def look_and_bend(p: Mapping[str, float], rng: float | np.ndarray):
    """Look angle and Earth-centre angle at slant range ``rng``."""
    radius = p["earth_radius"]
    centre = radius + p["SC_height"]
    return (rng**2 + centre**2 - radius**2) / (2 * rng * centre), (centre**2 + radius**2 - rng**2) / (2 * radius * centre)


def baseline_projections(p: Mapping[str, float], other: Mapping[str, float], length: float, alpha: float) -> tuple[float, float]:
    """Parallel and perpendicular parts of a baseline of ``length`` at ``alpha`` degrees, seen halfway across ``other``'s swath."""
    step = SPEED_OF_LIGHT / p["rng_samp_rate"] / 2
    near = other["near_range"]
    (l1, b1), (l2, b2) = look_and_bend(p, near), look_and_bend(p, near + step * other["num_rng_bins"])
    angle = math.acos((l1 + l2) / 2) + math.acos((b1 + b2) / 2) - math.radians(alpha)
    return length * math.sin(angle), length * math.cos(angle)


def baseline_components(baseline, ref, rep, descending: bool, left: bool) -> tuple[float, float]:
    """Vertical and horizontal part of a baseline vector between two orbit positions."""
    baseline, ref, rep = (np.asarray(v, float) for v in (baseline, ref, rep))
    sign = (-1 if descending else 1) * (-1 if left else 1) * (-1 if math.atan2(rep[1], rep[0]) < math.atan2(ref[1], ref[0]) else 1)
    vertical = float(baseline @ ref / np.linalg.norm(ref))
    return vertical, sign * math.sqrt(max(0.0, float(baseline @ baseline) - vertical**2))


def ellipsoid_height(x, y, z, equatorial: float = 6378137.0, polar: float = 6356752.31424518):
    """Height over, and radius of, the ellipsoid below an Earth-centred point."""
    r = np.sqrt(x**2 + y**2 + z**2)
    lat = np.arcsin(z / r)
    below = 1 / np.sqrt(np.cos(lat) ** 2 / equatorial**2 + np.sin(lat) ** 2 / polar**2)
    return r - below, below


def scene_seconds(p: Mapping[str, float]) -> tuple[float, float]:
    start = 86400 * p["clock_start"] + (p["ashift"] + p["sub_int_a"] + (p["nrows"] - p["num_valid_az"]) / 2) / p["PRF"]
    return start, start + p["num_patches"] * p["num_valid_az"] / p["PRF"]
