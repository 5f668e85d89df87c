"""Column functions for complex samples, wrapped phases, displacement units and missing values.

A complex sample is ``struct<re, im>``. Missing values are NULL in tables; ``missing`` turns NaN into NULL at the sources.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi
SPEED_OF_LIGHT = 299792458.0


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def missing(c: Column | str) -> Column:
    """NULL for NaN."""
    c = _col(c)
    return F.when(~F.isnan(c), c)


def finite(c: Column | str) -> Column:
    """Whether a value is neither NULL, NaN nor infinite."""
    c = _col(c)
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


# ---- complex samples


def c_new(re: Column | str, im: Column | str) -> Column:
    return F.struct(_col(re).alias("re"), _col(im).alias("im"))


def c_mul(a: Column, b: Column) -> Column:
    return c_new(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def c_conj(a: Column) -> Column:
    return c_new(a["re"], -a["im"])


def c_abs(a: Column) -> Column:
    return F.sqrt(a["re"] * a["re"] + a["im"] * a["im"])


def c_abs2(a: Column) -> Column:
    return a["re"] * a["re"] + a["im"] * a["im"]


def c_arg(a: Column) -> Column:
    return F.atan2(a["im"], a["re"])


def c_exp(angle: Column | str) -> Column:
    """exp(i * angle)."""
    angle = _col(angle)
    return c_new(F.cos(angle), F.sin(angle))


# ---- phases


def floor_mod(c: Column, m: float) -> Column:
    """Remainder with the divisor's sign, written as both Spark and other engines evaluate it."""
    return c - F.lit(m) * F.floor(c / F.lit(m))


def wrap(phase: Column | str) -> Column:
    """To [-pi, pi)."""
    return floor_mod(_col(phase) + math.pi, TWO_PI) - math.pi


def to_positive(phase: Column | str) -> Column:
    """(phase + 2 pi) mod 2 pi, in [0, 2 pi)."""
    return floor_mod(_col(phase) + TWO_PI, TWO_PI)


def to_symmetric(phase: Column | str) -> Column:
    return wrap(phase)


def coherence(product: Column, intensity1: Column, intensity2: Column) -> Column:
    """|product| / sqrt(I1 I2), clipped to [0, 1]; NULL stays, a zero denominator gives NULL."""
    raw = F.try_divide(c_abs(product), F.sqrt(intensity1 * intensity2))
    return F.when(raw.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))


# ---- displacement and height


def los_displacement_mm(phase: Column | str, wavelength: float) -> Column:
    return F.lit(-79.58 * wavelength) * _col(phase)


def incidence_angle(east: Column | str, north: Column | str, up: Column | str) -> Column:
    east, north = _col(east), _col(north)
    return F.atan2(F.sqrt(east * east + north * north), _col(up))


def los_projection(look: tuple[str, str, str], move: tuple[str, str, str]) -> Column:
    """Dot product of a look vector and a displacement, each given by its east, north and up columns."""
    return sum((_col(a) * _col(b) for a, b in zip(look[1:], move[1:], strict=True)), _col(look[0]) * _col(move[0]))


def vertical_displacement_mm(phase: Column | str, incidence: Column | str, wavelength: float) -> Column:
    return los_displacement_mm(phase, wavelength) / F.cos(_col(incidence))


def eastwest_displacement_mm(phase: Column | str, incidence: Column | str, wavelength: float, descending: bool) -> Column:
    sign = 1.0 if descending else -1.0
    return F.lit(sign) * los_displacement_mm(phase, wavelength) / F.sin(_col(incidence))


def elevation_m(phase: Column | str, slant: Column | str, incidence: Column | str, wavelength: float, baseline: float = 1.0) -> Column:
    return F.lit(-wavelength) * _col(phase) * _col(slant) * F.cos(_col(incidence)) / F.lit(4 * math.pi * baseline)


def slant_at(x: Column | str, size: int, start: float, end: float) -> Column:
    """Even steps from ``start`` to ``end`` over columns numbered from 0."""
    return F.lit(start) + _col(x) * F.lit((end - start) / max(1, size - 1))


def tidal_los_rad(tidal_los: Column | str, wavelength: float) -> Column:
    """Phase of a line-of-sight tide in metres."""
    return F.lit(1000.0 / (-79.58 * wavelength)) * _col(tidal_los)


def tidal_correction_wrap(phase: Column | str, tide_rad: Column | str) -> Column:
    return wrap(_col(phase) - _col(tide_rad))


# ---- web map tiles


def tile_x(lon: Column | str, zoom: int) -> Column:
    return F.floor((_col(lon) + 180.0) / 360.0 * float(1 << zoom)).cast("int")


def tile_y(lat: Column | str, zoom: int) -> Column:
    rad = F.radians(_col(lat))
    return F.floor((F.lit(1.0) - F.asinh(F.tan(rad)) / math.pi) / 2.0 * float(1 << zoom)).cast("int")


def tile_lon(x: Column | str, zoom: int) -> Column:
    return _col(x) / float(1 << zoom) * 360.0 - 180.0


def tile_lat(y: Column | str, zoom: int) -> Column:
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (F.lit(1.0) - _col(y) * 2.0 / float(1 << zoom)))))
