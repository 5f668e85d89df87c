"""Binary raster files: height tiles, GeoTIFF and classic NetCDF, read by tasks and written a tile or a line at a time.

A file is one sequence of bytes, so whoever writes it goes through its pieces in order; tasks encode the pieces, and the
driver holds one of them at a time.
"""

from __future__ import annotations

import gzip
import io
import math
import re
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringework import shared
from fringework.operators.raster import Grid

CELLS = "path string, lat double, lon double, {value} double"


def write_bytes(spark: SparkSession, path: str, pieces: Iterable[bytes]) -> None:
    """One file from pieces in order, on any file system that Spark knows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        for x in pieces:
            out.write(bytearray(x))
    finally:
        out.close()


def files(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of the files below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def unpacked(raw: bytes) -> bytes:
    """The content of a gzip or zip file (its first member); other bytes as they are."""
    if raw[:2] == b"\x1f\x8b":
        return gzip.decompress(raw)
    if raw[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            return z.read(z.namelist()[0])
    return raw


def _cells(found: DataFrame, decode, value: str) -> DataFrame:
    """Rows of cells from files by ``decode(path, bytes)``, which yields (lats, lons, 2-D values)."""
    shared.ship(found.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, raw in zip(b["path"], b["content"], strict=True):
                for lats, lons, a in decode(path, unpacked(bytes(raw))):
                    yield pd.DataFrame({"path": path, "lat": np.repeat(lats, len(lons)), "lon": np.tile(lons, len(lats)), value: a.reshape(-1)})

    out = found.select("path", "content").mapInPandas(run, CELLS.format(value=value))
    return out.withColumn(value, F.when(~F.isnan(value), F.col(value)))


# ---- height tiles


def _height_tile(path: str, raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    m = re.search(r"([NS])(\d{2})([EW])(\d{3})[^/]*$", path)
    n = math.isqrt(len(raw) // 2)
    if not m or 2 * n * n != len(raw) or n < 2:
        raise ValueError(f"{path} isn't a height tile")
    south = int(m[2]) * (1 if m[1] == "N" else -1)
    west = int(m[4]) * (1 if m[3] == "E" else -1)
    a = np.frombuffer(raw, ">i2").reshape(n, n).astype(float)
    a[a == -32768] = np.nan
    for i in range(0, n, 256):  # from north to south
        yield south + 1 - np.arange(i, min(n, i + 256)) / (n - 1), west + np.arange(n) / (n - 1), a[i : i + 256]


def height_tiles(found: DataFrame, value: str = "ele") -> DataFrame:
    """``path, lat, lon, ele`` of one-degree tiles of big-endian int16 heights, gzipped, zipped or plain, named after their
    southern and western edges (like N05E010.hgt); -32768 is missing. ``found``: path, content."""
    return _cells(found, _height_tile, value)


# ---- GeoTIFF

KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d", 16: "Q"}
SAMPLES = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


def _tags(raw: bytes) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}[raw[:2]]
    big = struct.unpack_from(order + "H", raw, 2)[0] == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), raw, 8 if big else 4)[0]
    many = struct.unpack_from(order + ("Q" if big else "H"), raw, at)[0]
    at += 8 if big else 2
    out = {}
    for _ in range(many):
        tag, kind, count = struct.unpack_from(order + ("HHQ" if big else "HHI"), raw, at)
        code = KINDS.get(kind)
        size = struct.calcsize(code) * count if code else 0
        place = at + (12 if big else 8)
        if size > (8 if big else 4):
            place = struct.unpack_from(order + ("Q" if big else "I"), raw, place)[0]
        if code:
            out[tag] = struct.unpack_from(f"{order}{count * len(code)}{code[0]}", raw, place)
        at += 20 if big else 12
    return order, out


def _geotiff(path: str, raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    order, t = _tags(raw)
    one = lambda k, other=None: t[k][0] if k in t else other
    width, height, packing = one(256), one(257), one(259, 1)
    kind = SAMPLES.get((one(339, 1), one(258, 1)))
    if kind is None or packing not in (1, 8, 32946) or one(277, 1) != 1 or one(317, 1) != 1:
        raise ValueError(f"{path}: one band of whole or floating numbers, plain or deflated, is read")
    tiled = 322 in t
    tw, th = (one(322), one(323)) if tiled else (width, one(278, height))
    offsets, counts = (t[324], t[325]) if tiled else (t[273], t[279])
    (sx, sy, _), (i, j, _, x, y, _) = t[33550], t[33922]
    point = 0.0 if 34735 in t and any(t[34735][k : k + 4] == (1025, 0, 1, 2) for k in range(4, len(t[34735]), 4)) else 0.5
    nodata = float(bytes(b"".join(t[42113])).rstrip(b"\0").decode() or "nan") if 42113 in t else math.nan
    across = -(-width // tw)
    for k, (at, size) in enumerate(zip(offsets, counts, strict=True)):
        top, left = k // across * th, k % across * tw
        h, w = min(th, height - top), min(tw, width - left)
        if size:
            data = raw[at : at + size]
            a = np.frombuffer(zlib.decompress(data) if packing != 1 else data, order + kind).astype(float)
            a = a.reshape(-1, tw)[:h, :w]
            a = np.where(a == nodata, np.nan, a)
        else:
            a = np.full((h, w), np.nan)
        yield y - (np.arange(top, top + h) + point - j) * sy, x + (np.arange(left, left + w) + point - i) * sx, a


def read_geotiff(found: DataFrame, value: str = "v") -> DataFrame:
    """``path, lat, lon, value`` of the cell centres of files (path, content) of one band; cells without data are NULL."""
    return _cells(found, _geotiff, value)


def _tiff_head(g: Grid, tile: int, lengths: list[int], epsg: int) -> bytes:
    nodata = b"nan\0"
    geo = (1, 1, 0, 3, 1024, 0, 1, 2 if epsg == 4326 else 1, 1025, 0, 1, 1, 2048 if epsg == 4326 else 3072, 0, 1, epsg)
    n = len(lengths)
    tags: list[tuple[int, int, tuple]] = [
        (256, 4, (g.nx,)), (257, 4, (g.ny,)), (258, 3, (32,)), (259, 3, (8,)), (262, 3, (1,)), (277, 3, (1,)), (322, 4, (tile,)), (323, 4, (tile,)),
        (324, 16, (0,) * n), (325, 16, tuple(lengths)), (339, 3, (3,)), (33550, 12, (g.dx, g.dy, 0.0)), (33922, 12, (0.0, 0.0, 0.0, g.x0 - g.dx / 2, g.y0 + (g.ny - 0.5) * g.dy, 0.0)), (34735, 3, geo), (42113, 2, (nodata,)),
    ]
    sizes = [len(nodata) if kind == 2 else struct.calcsize(KINDS[kind]) * len(v) for _, kind, v in tags]
    start = 16 + 8 + 20 * len(tags) + 8
    places, at = [], start
    for size in sizes:
        places.append(at)
        at += 0 if size <= 8 else -(-size // 8) * 8
    offsets = [0] * n
    for k, size in enumerate(lengths):
        offsets[k], at = (at if size else 0), at + size
    body, head = b"", struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) + struct.pack("<Q", len(tags))
    for (tag, kind, v), size, place in zip(tags, sizes, places, strict=True):
        v = tuple(offsets) if tag == 324 else v
        raw = v[0] if kind == 2 else struct.pack(f"<{len(v)}{KINDS[kind]}", *v)
        head += struct.pack("<HHQ", tag, kind, size if kind == 2 else len(v)) + (raw.ljust(8, b"\0") if size <= 8 else struct.pack("<Q", place))
        body += b"" if size <= 8 else raw.ljust(-(-size // 8) * 8, b"\0")
    return head + struct.pack("<Q", 0) + body


def write_geotiff(data: DataFrame, path: str, value: str, grid: Grid, tile: int = 256, epsg: int = 4326, y: str = "lat", x: str = "lon") -> None:
    """A BigTIFF of one float band with deflated tiles; missing cells are NaN, tiles without a cell take no room.

    Tasks encode the tiles; the driver holds their lengths and passes them on to the file one by one.
    """
    spark = data.sparkSession
    shared.ship(spark)
    g, across = grid, -(-grid.nx // tile)
    rows = data.select((F.lit(g.ny - 1) - g.iy(F.col(y))).alias("row"), g.ix(F.col(x)).alias("col"), F.col(value).cast("float").alias("v"))
    rows = rows.filter(F.col("row").between(0, g.ny - 1) & F.col("col").between(0, g.nx - 1))
    rows = rows.withColumn("tile", (F.floor(F.col("row") / tile) * across + F.floor(F.col("col") / tile)).cast("long"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.full((tile, tile), np.nan, "<f4")
        a[pdf["row"].to_numpy() % tile, pdf["col"].to_numpy() % tile] = pdf["v"].to_numpy(dtype="float32", na_value=np.nan)
        return pd.DataFrame({"tile": [int(pdf["tile"].iloc[0])], "data": [zlib.compress(a.tobytes())]})

    tiles = shared.materialise(rows.groupBy("tile").applyInPandas(run, "tile long, data binary"), "tiles")
    lengths = [0] * (across * -(-g.ny // tile))
    for r in tiles.select("tile", F.length("data").alias("n")).collect():
        lengths[r.tile] = r.n

    def pieces() -> Iterator[bytes]:
        yield _tiff_head(g, tile, lengths, epsg)
        for r in tiles.orderBy("tile").toLocalIterator():
            yield bytes(r.data)

    write_bytes(spark, path, pieces())
    shared.drop_table(spark, tiles)


# ---- classic NetCDF (64-bit offsets)


def _name(s: str) -> bytes:
    raw = s.encode()
    return struct.pack(">I", len(raw)) + raw.ljust(-(-len(raw) // 4) * 4, b"\0")


def write_netcdf(data: DataFrame, path: str, value: str, grid: Grid, y: str = "lat", x: str = "lon") -> None:
    """A classic NetCDF file with coordinates ``y, x`` and one float variable; missing cells are NaN.

    Tasks encode lines of the grid; the driver passes them on to the file in order, lines without a cell as NaN.
    """
    spark, g = data.sparkSession, grid
    shared.ship(spark)
    rows = data.select(g.iy(F.col(y)).alias("row"), g.ix(F.col(x)).alias("col"), F.col(value).cast("float").alias("v")).filter(F.col("row").between(0, g.ny - 1) & F.col("col").between(0, g.nx - 1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.full(g.nx, np.nan, ">f4")
        a[pdf["col"].to_numpy()] = pdf["v"].to_numpy(dtype="float32", na_value=np.nan)
        return pd.DataFrame({"row": [int(pdf["row"].iloc[0])], "data": [a.tobytes()]})

    lines = shared.materialise(rows.groupBy("row").applyInPandas(run, "row long, data binary"), "lines")
    none = struct.pack(">II", 0, 0)
    variables = [(y, (0,), 6, 8 * g.ny), (x, (1,), 6, 8 * g.nx), (value, (0, 1), 5, 4 * g.ny * g.nx)]
    dims = struct.pack(">II", 10, 2) + _name(y) + struct.pack(">I", g.ny) + _name(x) + struct.pack(">I", g.nx)
    size = 8 + len(dims) + 8 + 8 + sum(len(_name(n)) + 4 + 4 * len(d) + 8 + 4 + 4 + 8 for n, d, _, _ in variables)
    head, at = b"CDF\x02" + struct.pack(">I", 0) + dims + none + struct.pack(">II", 11, len(variables)), size
    for n, d, kind, many in variables:
        head += _name(n) + struct.pack(f">I{len(d)}I", len(d), *d) + none + struct.pack(">IIQ", kind, min(many, 0xFFFFFFFC), at)
        at += many

    def pieces() -> Iterator[bytes]:
        yield head + (g.y0 + g.dy * np.arange(g.ny)).astype(">f8").tobytes() + (g.x0 + g.dx * np.arange(g.nx)).astype(">f8").tobytes()
        blank, at = np.full(g.nx, np.nan, ">f4").tobytes(), 0
        for r in lines.orderBy("row").toLocalIterator():
            for _ in range(at, r.row):
                yield blank
            yield bytes(r.data)
            at = r.row + 1
        for _ in range(at, g.ny):
            yield blank

    write_bytes(spark, path, pieces())
    shared.drop_table(spark, lines)


def _netcdf(path: str, raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    if raw[:3] != b"CDF" or raw[3] not in (1, 2):
        raise ValueError(f"{path} isn't a classic NetCDF file")
    at, kinds = 8, {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}

    def number(code: str = ">I") -> int:
        nonlocal at
        out = struct.unpack_from(code, raw, at)[0]
        at += struct.calcsize(code)
        return out

    def name() -> str:
        nonlocal at
        n = number()
        out = raw[at : at + n].decode()
        at += -(-n // 4) * 4
        return out

    def attributes() -> None:
        nonlocal at
        number()
        for _ in range(number()):
            name()
            kind, n = number(), number()
            at += -(-np.dtype(kinds[kind]).itemsize * n // 4) * 4

    number()
    dims = [(name(), number()) for _ in range(number())]
    attributes()
    number()
    arrays = {}
    for _ in range(number()):
        n, d = name(), [dims[number()] for _ in range(number())]
        attributes()
        kind, _, begin = number(), number(), number(">Q" if raw[3] == 2 else ">I")
        arrays[n] = [k for k, _ in d], np.frombuffer(raw, kinds[kind], math.prod(m for _, m in d), begin).reshape([m for _, m in d]).astype(float)
    for names, a in arrays.values():
        if len(names) == 2:
            lats, lons = (arrays[k][1] for k in names)
            for i in range(0, len(lats), 256):
                yield lats[i : i + 256], lons, a[i : i + 256]
            return
    raise ValueError(f"{path} has no variable of two dimensions")


def read_netcdf(found: DataFrame, value: str = "v") -> DataFrame:
    """``path, lat, lon, value`` of the first two-dimensional variable of classic NetCDF files (path, content)."""
    return _cells(found, _netcdf, value)
