"""Parameter tables: name/value pairs of a scene as a map column, with override, difference and derived values.

Tables have ``date, subswath, params MAP<STRING, STRING>``. Values are text; ``number`` reads them as doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fringework.functions.columns import SPEED_OF_LIGHT

#: names whose values are whole numbers
WHOLE = ("num_valid_az", "num_rng_bins", "num_patches", "bytes_per_line", "good_bytes_per_line", "num_lines", "SLC_scale")


def parse(line: Column) -> Column:
    """A ``name = value`` line as a struct."""
    return F.struct(F.trim(F.regexp_extract(line, r"^\s*(.*?)\s+=\s+(.*?)\s*$", 1)).alias("name"), F.regexp_extract(line, r"^\s*(.*?)\s+=\s+(.*?)\s*$", 2).alias("value"))


def to_map(entries: Column) -> Column:
    """An array of name/value structs as a map; of equal names the last counts."""
    named = F.filter(entries, lambda e: e["name"] != "")
    names = F.array_distinct(F.transform(named, lambda e: e["name"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(named, lambda e: e["name"] == n), -1)["value"]))


def from_text(text: Column) -> Column:
    return to_map(F.transform(F.split(text, "\n"), parse))


def from_lines(spark: SparkSession, lines: list[str]) -> DataFrame:
    return spark.createDataFrame([("\n".join(lines),)], "text string").select(from_text(F.col("text")).alias("params"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Parameter files: ``file, params``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), from_text(F.col("value")).alias("params"))


def to_text(params: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit(" = "), e["value"])), "\n")


def write(table: DataFrame, path: str) -> None:
    table.select(to_text(F.col("params")).alias("value")).write.mode("overwrite").text(path)


def merge(base: Column, other: Column) -> Column:
    """All names of both; where both have one, the other's value."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(other, k)), other)


def with_values(params: Column, **values) -> Column:
    return merge(params, F.create_map(*(F.lit(str(x)) for kv in values.items() for x in kv)))


def select(params: Column, *names: str) -> Column:
    return F.map_filter(params, lambda k, v: k.isin(*names))


def number(params: Column, name: str) -> Column:
    v = F.try_element_at(params, F.lit(name)).try_cast("double")
    return v.cast("long") if name in WHOLE else v


def shifted(params: Column, amount: float, sign: int = 1) -> Column:
    """Numeric values plus (or minus) a number; text stays."""
    return F.transform_values(params, lambda k, v: F.coalesce((v.try_cast("double") + sign * amount).cast("string"), v))


def explode(table: DataFrame, *keys: str) -> DataFrame:
    return table.select(*keys, F.explode("params").alias("name", "value"))


def _short(v: Column) -> Column:
    """A number with six significant digits, as ``%g`` writes it but without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6g", v), r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")


def difference(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys, name, value) that only one of both has, numbers compared by value."""
    plain = lambda d: d.select(*keys, "name", F.coalesce(_short(F.col("value").try_cast("double")), F.col("value")).alias("value"))
    a, b = plain(a), plain(b)
    return a.unionAll(b).groupBy(*keys, "name", "value").agg(F.count("*").alias("n")).filter("n = 1").drop("n")


def same(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def latest(entries: DataFrame, order: str, *keys: str) -> DataFrame:
    """Of rows (keys, name, value) the last of each name by ``order``."""
    w = Window.partitionBy(*keys, "name").orderBy(F.desc(order))
    return entries.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", order)


def shift_time(params: Column, lines: Column | float) -> Column:
    """Clock values moved by azimuth lines."""
    names = ["clock_start", "clock_stop", "SC_clock_start", "SC_clock_stop"]
    by = F.lit(lines) / number(params, "PRF") / 86400.0
    return F.transform_values(params, lambda k, v: F.when(k.isin(*names), (v.try_cast("double") + by).cast("string")).otherwise(v))


def fix_merged(params: Column, maxy: Column, maxx: Column, minh: Column) -> Column:
    """Extents of a merged scene, and its clock moved by the lines it begins earlier."""
    prf = number(params, "PRF")
    start, sc = number(params, "clock_start") + minh / prf / 86400, number(params, "SC_clock_start") + minh / prf / 86400
    span = maxy / prf / 86400
    new = {"num_lines": maxy, "nrows": maxy, "num_valid_az": maxy, "num_rng_bins": maxx, "clock_start": start, "clock_stop": start + span, "SC_clock_start": sc, "SC_clock_stop": sc + span}
    return merge(params, F.create_map(*(x for k, v in new.items() for x in (F.lit(k), v.cast("string")))))


def fix_aligned(params: Column) -> Column:
    """Near range and clocks with the shifts of an alignment applied."""
    prf = number(params, "PRF")
    step = SPEED_OF_LIGHT / number(params, "rng_samp_rate") / 2
    zero = lambda n: F.coalesce(number(params, n), F.lit(0.0))
    near = number(params, "near_range") + (zero("st_rng_bin") - 1 + zero("rshift") + zero("sub_int_r")) * step
    late = (zero("ashift") + zero("sub_int_a")) / prf / 86400
    new = {"near_range": near, "SC_clock_start": number(params, "SC_clock_start") + late, "SC_clock_stop": number(params, "SC_clock_start") + late + number(params, "num_valid_az") * F.coalesce(zero("num_patches"), F.lit(1)) / prf / 86400}
    return merge(params, F.create_map(*(x for k, v in new.items() for x in (F.lit(k), v.cast("string")))))


def stitching(table: DataFrame) -> DataFrame:
    """Where the subswaths of each date lie in the merged grid: ``date, subswath, bottom, overlap, left, maxy, maxx, minh``.

    Azimuth offsets come from clocks and PRF, range overlaps from near ranges; subswaths of a date are a handful of rows.
    """
    p = F.col("params")
    w = Window.partitionBy("date").orderBy("subswath")
    rows = table.select("date", "subswath", *(number(p, n).alias(n) for n in ("clock_start", "PRF", "near_range", "rng_samp_rate", "num_rng_bins", "num_valid_az")))
    first = F.first("clock_start").over(w)
    rows = rows.withColumn("head", F.round((F.col("clock_start") - first) * 86400 * F.first("PRF").over(w)).cast("long"))
    step = SPEED_OF_LIGHT / F.lag("rng_samp_rate").over(w) / 2
    over = F.lag("num_rng_bins").over(w) - F.round((F.col("near_range") - F.lag("near_range").over(w)) / step).cast("long")
    rows = rows.withColumn("overlap", over)
    every = Window.partitionBy("date")
    rows = rows.withColumn("minh", F.min("head").over(every)).withColumn("bottom", F.col("head") - F.col("minh"))
    wide = F.col("num_rng_bins") - F.coalesce(F.col("overlap"), F.lit(-1)) - 1
    return rows.select("date", "subswath", "bottom", "overlap", (F.sum(wide).over(w) - wide).alias("left"), F.max(F.col("num_valid_az") + F.col("bottom")).over(every).alias("maxy"), F.sum(wide).over(every).alias("maxx"), "minh")
