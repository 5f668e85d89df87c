"""Scene catalogs from file names, annotations and orbit files; request lists against what is on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: mission-iw<subswath>-slc-<polarization>-<start>-<stop>-<orbit>-<data take>-<image>
NAME = r"^(s1[abc])-iw(\d)-slc-(vv|vh|hh|hv)-(\d{8}t\d{6})-(\d{8}t\d{6})-(\d{6})-([0-9a-f]{6})-(\d{3})$"
ORBIT = r"^(S1[ABC])_OPER_AUX_(POE|RES)ORB_OPOD_(\d{8}T\d{6})_V(\d{8}T\d{6})_(\d{8}T\d{6})"


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Paths below a folder, without reading the files: ``path, name, extension, size``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", F.col("length").alias("size"))
    base = F.element_at(F.split("path", "/"), -1)
    return files.select("path", F.regexp_replace(base, r"\.[^.]*$", "").alias("name"), F.lower(F.regexp_extract(base, r"\.([^.]*)$", 1)).alias("extension"), "size")


def named(files: DataFrame) -> DataFrame:
    """Date, time, mission, subswath and polarization from scene names; other files are left out."""
    p = lambda k: F.regexp_extract("name", NAME, k)
    start = F.try_to_timestamp(p(4), F.lit("yyyyMMdd't'HHmmss"))
    return files.filter(F.col("name").rlike(NAME)).select("*", start.alias("datetime"), F.date_format(start, "yyyy-MM-dd").alias("date"), F.upper(p(1)).alias("mission"), p(2).cast("int").alias("subswath"), F.upper(p(3)).alias("polarization"))


def orbit_files(files: DataFrame) -> DataFrame:
    p = lambda k: F.regexp_extract("name", ORBIT, k)
    stamp = lambda k: F.try_to_timestamp(p(k), F.lit("yyyyMMdd'T'HHmmss"))
    return files.filter(F.col("name").rlike(ORBIT)).select("path", p(1).alias("mission"), p(2).alias("kind"), stamp(3).alias("created"), stamp(4).alias("start"), stamp(5).alias("stop"))


def with_orbits(scenes: DataFrame, orbits: DataFrame) -> DataFrame:
    """Each scene with its orbit file by days of validity: (day before, day after) before (day before, day) before (day, day)."""
    o = orbits.select("mission", F.to_date("start").alias("a"), F.to_date("stop").alias("b"), F.col("path").alias("orbitpath"))
    o = o.groupBy("mission", "a", "b").agg(F.max("orbitpath").alias("orbitpath"))
    day = F.to_date("datetime")
    out = scenes
    for k, (before, after) in enumerate(((1, 1), (1, 0), (0, 0))):
        one = o.select("mission", F.date_add("a", before).alias(f"_day{k}"), F.date_sub("b", after).alias(f"_end{k}"), F.col("orbitpath").alias(f"_path{k}"))
        one = one.filter(F.col(f"_day{k}") == F.col(f"_end{k}")).drop(f"_end{k}")
        out = out.withColumn(f"_day{k}", day).join(one, ["mission", f"_day{k}"], "left").drop(f"_day{k}")
    return out.withColumn("orbitpath", F.coalesce("_path0", "_path1", "_path2")).drop("_path0", "_path1", "_path2")


def valid_orbit(scenes: DataFrame, orbits: DataFrame) -> DataFrame:
    """The newest orbit file whose validity covers each (date, mission)'s first acquisition; restituted ones with margins of an
    hour before and five minutes after. Scenes and files meet by mission and day of validity, a bucketed range join."""
    first = scenes.groupBy("date", "mission").agg(F.min("datetime").alias("datetime"))
    o = orbits.withColumn("_day", F.explode(F.sequence(F.to_date("start"), F.to_date("stop"))))
    late, early = F.expr("interval 300 seconds"), F.expr("interval 3600 seconds")
    covers = F.when(F.col("kind") == "RES", (F.col("start") + early <= F.col("datetime")) & (F.col("datetime") <= F.col("stop") - late)).otherwise((F.col("start") <= F.col("datetime")) & (F.col("datetime") <= F.col("stop")))
    hits = first.withColumn("_day", F.to_date("datetime")).join(o, ["mission", "_day"]).filter(covers)
    w = Window.partitionBy("date", "mission").orderBy((F.col("kind") == "POE").desc(), F.desc("created"), "path")
    best = hits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("date", "mission", F.col("path").alias("orbitpath"), "kind")
    return first.join(best, ["date", "mission"], "left")


def problems(scenes: DataFrame) -> DataFrame:
    """What is wrong with a catalog, one row for each finding (none: it is sound)."""
    date_checks = scenes.groupBy("date").agg(F.count_distinct("mission").alias("missions"), F.count_distinct("subswath").alias("subswaths"), F.min("subswath").alias("low"), F.max("subswath").alias("high"), F.count("*").alias("n"))
    a = date_checks.filter("missions > 1").select("date", F.lit("several missions on one date").alias("problem"))
    b = date_checks.filter("high - low + 1 <> subswaths").select("date", F.lit("subswaths aren't sequential").alias("problem"))
    total = scenes.agg(F.count_distinct("date").alias("dates"), F.count_distinct("orbit").alias("orbits"))
    c = total.filter("dates < 2").select(F.lit(None).cast("string").alias("date"), F.lit("fewer than two dates").alias("problem"))
    d = total.filter("orbits > 1").select(F.lit(None).cast("string").alias("date"), F.lit("several orbits").alias("problem"))
    return a.unionAll(b).unionAll(c).unionAll(d)


def directions(spark: SparkSession, paths: str) -> DataFrame:
    """Pass direction (A or D) of annotations: ``metapath, orbit``."""
    rows = annotation(spark, paths, "productInformation")
    return rows.select(F.input_file_name().alias("metapath"), F.upper(F.substring("pass", 1, 1)).alias("orbit"))


def scan(spark: SparkSession, folder: str, orbit: str | None = None, mission: str | None = None, subswath: int | None = None, polarization: str | None = None) -> DataFrame:
    """The catalog of a folder: measurement (tiff) and annotation (xml) of each scene, its orbit file, sorted by (date, subswath)."""
    files = listing(spark, folder)
    scenes = named(files)
    data = scenes.filter(F.col("extension").isin("tiff", "tif")).withColumnRenamed("path", "datapath")
    meta = scenes.filter("extension = 'xml'").select("name", F.col("path").alias("metapath"))
    out = with_orbits(data.join(meta, "name", "left"), orbit_files(files.filter("extension = 'eof'")))
    for column, value in (("mission", mission), ("subswath", subswath), ("polarization", polarization)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    out = out.select("date", "datetime", "mission", "polarization", "subswath", "datapath", "metapath", "orbitpath")
    if orbit is not None:
        side = directions(spark, f"{folder}/*.xml").filter(F.col("orbit") == orbit)
        base = lambda c: F.element_at(F.split(c, "/"), -1)
        out = out.join(side.select(base("metapath").alias("_meta"), "orbit"), base("metapath") == F.col("_meta")).drop("_meta")
    return out.orderBy("date", "subswath")


def annotation(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """Elements of an annotation by their tag, nested elements as structs."""
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def geolocation(spark: SparkSession, path: str) -> DataFrame:
    """The geolocation grid: numbers as doubles and the point (lon, lat)."""
    raw = annotation(spark, path, "geolocationGridPoint")
    return raw.select(*(F.col(c).try_cast("double").alias(c) if c != "azimuthTime" and c != "slantRangeTime" else F.col(c) for c in raw.columns), F.struct(F.col("longitude").alias("lon"), F.col("latitude").alias("lat")).alias("point"))


def runs(rows: DataFrame, order: str, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Numbers runs of equal ``value`` in ``order``, from 1."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(1))
    return rows.withColumn("_c", changed).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def bursts(points: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Burst outlines from grid points in file order (n, line, lon, lat): each run of a line with two or more points is an edge,
    and each two edges that follow each other close a ring."""
    lines = runs(points, "n", "line", keys).groupBy(*keys, "run").agg(F.sort_array(F.collect_list(F.struct("n", "lon", "lat"))).alias("p")).filter(F.size("p") > 1)
    w = Window.partitionBy(*keys).orderBy("run")
    xy = lambda c: F.transform(c, lambda q: F.struct(q["lon"].alias("lon"), q["lat"].alias("lat")))
    pairs = lines.select(*keys, "run", "p", F.lead("p").over(w).alias("q")).filter("q IS NOT NULL")
    return pairs.select(*keys, F.col("run").alias("burst"), F.concat(xy("p"), F.reverse(xy("q")), F.slice(xy("p"), 1, 1)).alias("ring"))


def missing(requests: DataFrame, present: DataFrame, key: str = "name") -> DataFrame:
    """Requested scenes that aren't there yet."""
    return requests.join(present.select(key).distinct(), key, "left_anti")


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Burst requests and whole scenes."""
    burst = F.col("name").endswith("-BURST")
    return requests.filter(burst), requests.filter(~burst)


def near_time(rows: DataFrame, when: Column | str, seconds: float = 3.0, column: str = "azimuthTime") -> DataFrame:
    """Rows within some seconds of a time."""
    t = F.lit(when).cast("timestamp") if isinstance(when, str) else when
    return rows.filter(F.abs(F.unix_micros(F.col(column).cast("timestamp")) - F.unix_micros(t)) <= int(seconds * 1e6))


def burst_lines(rows: DataFrame, length: int, index: int, column: str = "line") -> DataFrame:
    """Line numbers counted from the start of burst ``index``."""
    return rows.withColumn(column, F.col(column) - length * index)


def subswaths(scenes: DataFrame) -> DataFrame:
    return scenes.select("subswath").distinct().orderBy("subswath")


def reference(scenes: DataFrame, date: str, subswath: int | None = None) -> DataFrame:
    """Rows of the reference date; of merged subswaths (like 123) those whose first digit is asked for."""
    out = scenes.filter(F.col("date") == date)
    return out if subswath is None else out.filter((F.col("subswath") == subswath) | (F.substring(F.col("subswath").cast("string"), 1, 1) == str(subswath)))


def repeats(scenes: DataFrame, date: str, subswath: int | None = None) -> DataFrame:
    out = scenes.filter(F.col("date") != date)
    return out if subswath is None else out.filter(F.col("subswath") == subswath)


def prefix(date: Column | str, subswath: Column | str) -> Column:
    return F.format_string("%s_F%d", date, subswath)


def within(scenes: DataFrame, minx: float, miny: float, maxx: float, maxy: float, ring: str = "ring") -> DataFrame:
    """Rows whose outline's bounding box meets a box, for crops to an area."""
    xs, ys = F.transform(ring, lambda p: p["lon"]), F.transform(ring, lambda p: p["lat"])
    return scenes.filter((F.array_max(xs) >= minx) & (F.array_min(xs) <= maxx) & (F.array_max(ys) >= miny) & (F.array_min(ys) <= maxy))
