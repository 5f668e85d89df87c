"""Networks of date pairs.

A pair table has ``ref DATE, rep DATE, pair STRING, ref_baseline, rep_baseline, baseline DOUBLE, duration INT, rel DATE``.
Scene tables have ``date DATE, bperp DOUBLE``. Dates are few next to pixels, but nothing here is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fringework import shared
from fringework.functions.columns import wrap

KEY = ["ref", "rep"]


def pair_name(ref: Column | str = "ref", rep: Column | str = "rep") -> Column:
    return F.concat_ws(" ", F.date_format(ref, "yyyy-MM-dd"), F.date_format(rep, "yyyy-MM-dd"))


def make_pairs(scenes: DataFrame, days: int | None = None, meters: float | None = None, invert: bool = False) -> DataFrame:
    """All pairs ``ref < rep`` less than ``days + 1`` days and ``meters + 1`` metres apart, swapped if ``invert``.

    With a day limit the dates meet in buckets of that many days (each date looks into its own and the next bucket), an
    equi-join that doesn't compare all dates with all dates.
    """
    one = scenes.select("date", F.col("bperp").cast("double").alias("b"))
    width = max(1, days) if days is not None else 1_000_000
    bucket = F.floor(F.datediff(F.col("date"), F.lit("1970-01-01").cast("date")) / width)
    a = one.select(F.col("date").alias("ref"), F.col("b").alias("ref_b"), F.explode(F.array(bucket, bucket + 1)).alias("k"))
    z = one.select(F.col("date").alias("rep"), F.col("b").alias("rep_b"), bucket.alias("k"))
    cond = (F.col("ref") < F.col("rep")) & (F.datediff("rep", "ref") < width + 1)
    if meters is not None:
        cond &= F.abs(F.col("ref_b") - F.col("rep_b")) < meters + 1
    p = a.join(z, "k").filter(cond)
    if invert:
        p = p.select(F.col("rep").alias("ref"), F.col("ref").alias("rep"), F.col("rep_b").alias("ref_b"), F.col("ref_b").alias("rep_b"))
    return p.select(
        "ref",
        "rep",
        pair_name().alias("pair"),
        F.round("ref_b", 2).alias("ref_baseline"),
        F.round("rep_b", 2).alias("rep_baseline"),
        F.round(F.col("rep_b") - F.col("ref_b"), 2).alias("baseline"),
        F.datediff("rep", "ref").alias("duration"),
        F.lit(None).cast("date").alias("rel"),
    )


def consecutive_pairs(scenes: DataFrame) -> DataFrame:
    """Each date with the next one."""
    w = Window.orderBy("date")  # one row for each date
    return scenes.select(F.col("date").alias("ref"), F.lead("date").over(w).alias("rep")).filter("rep IS NOT NULL").withColumn("pair", pair_name())


def normalise(pairs: DataFrame | Iterable, spark=None) -> DataFrame:
    """``ref, rep, pair`` from a table with these columns, with a ``pair`` text only, or from 2-tuples."""
    if not isinstance(pairs, DataFrame):
        rows = [tuple(map(str, p)) for p in pairs]
        pairs = spark.createDataFrame(rows, "ref string, rep string")
    if "ref" not in pairs.columns:
        pairs = pairs.select("*", F.split("pair", " ")[0].alias("ref"), F.split("pair", " ")[1].alias("rep"))
    return pairs.select(F.to_date("ref").alias("ref"), F.to_date("rep").alias("rep")).withColumn("pair", pair_name())


def dates_of(pairs: DataFrame) -> DataFrame:
    """Distinct dates of both roles."""
    return pairs.select(F.col("ref").alias("date")).union(pairs.select(F.col("rep").alias("date"))).distinct()


def drop_dates(pairs: DataFrame, dates: DataFrame) -> DataFrame:
    """Pairs that touch none of ``dates`` (column ``date``)."""
    d = dates.select("date").distinct()
    return pairs.join(d, pairs["ref"] == d["date"], "left_anti").join(d, pairs["rep"] == d["date"], "left_anti")


def limit_degree(pairs: DataFrame, limit: int = 2, iterations: int = 1) -> DataFrame:
    """For each degree from 1 to ``limit``, ``iterations`` times: keep pairs whose dates both occur in that many pairs.

    A fixed number of passes, not a fixed point: a date of smaller degree may be left.
    """
    now = shared.materialise(pairs, "network")
    for degree in range(1, limit + 1):
        for _ in range(iterations):
            ends = now.select(F.explode(F.array("ref", "rep")).alias("date"))
            good = ends.groupBy("date").agg(F.count("*").alias("n")).filter(F.col("n") >= degree).select("date")
            kept = now.join(good.withColumnRenamed("date", "ref"), "ref", "left_semi").join(good.withColumnRenamed("date", "rep"), "rep", "left_semi")
            now = shared.materialise(kept.select(*pairs.columns), "network")  # a plan that grows with each pass would not end
    return now


def extend(pairs: DataFrame) -> DataFrame:
    """Adds (a, c) for pairs (a, b) and (b, c) where it isn't a pair yet; ``rel`` is b, the earliest if there are several."""
    p = pairs.select("ref", "rep", "ref_baseline", "rep_baseline")
    a, b = p.alias("a"), p.alias("b")
    made = (
        a.join(b, F.col("a.rep") == F.col("b.ref"))
        .select(F.col("a.ref").alias("ref"), F.col("b.rep").alias("rep"), F.col("a.rep").alias("rel"), F.col("a.ref_baseline").alias("ref_baseline"), F.col("b.rep_baseline").alias("rep_baseline"))
        .join(p.select(*KEY), KEY, "left_anti")
        .groupBy(*KEY)
        .agg(F.min(F.struct("rel", "ref_baseline", "rep_baseline")).alias("m"))
        .select("ref", "rep", pair_name().alias("pair"), "m.ref_baseline", "m.rep_baseline", F.round(F.col("m.rep_baseline") - F.col("m.ref_baseline"), 2).alias("baseline"), F.datediff("rep", "ref").alias("duration"), F.col("m.rel").alias("rel"))
    )
    return pairs.unionByName(made)


def covering(pairs: DataFrame, column: str, count: int, func: str = "min") -> DataFrame:
    """Pairs that are, for some day from their ref to their rep, among the ``count`` smallest (``max``: largest) by ``column``; ties by (ref, rep)."""
    if func not in ("min", "max"):
        raise ValueError(f"func is min or max, not {func}")
    order = F.col(column).asc() if func == "min" else F.col(column).desc()
    days = pairs.withColumn("day", F.explode(F.sequence("ref", "rep")))
    best = days.withColumn("n", F.row_number().over(Window.partitionBy("day").orderBy(order, *KEY))).filter(F.col("n") <= count)
    return best.drop("n", "day").dropDuplicates(KEY)


def covering_deviation(pairs: DataFrame, count: int, column: str = "stddev") -> DataFrame:
    return covering(pairs, column, count, "min")


def covering_correlation(pairs: DataFrame, count: int, column: str = "corr") -> DataFrame:
    return covering(pairs, column, count, "max")


# ---- incidence


def incidence(pairs: DataFrame) -> DataFrame:
    """``pair, date, code``: -1 at ref, 1 at rep, 0 between them, NULL elsewhere. Pairs and dates are few, pixels aren't involved."""
    d = F.broadcast(dates_of(pairs))  # one row for each date
    code = F.when(F.col("date") == F.col("ref"), -1).when(F.col("date") == F.col("rep"), 1).when((F.col("date") > F.col("ref")) & (F.col("date") < F.col("rep")), 0)
    return pairs.select("ref", "rep", "pair").join(d, F.lit(True)).select("pair", "ref", "rep", "date", code.cast("float").alias("code"))


def inversion_matrix(pairs: DataFrame) -> DataFrame:
    """1 for dates in (ref, rep], else 0."""
    return incidence(pairs).select("pair", "ref", "rep", "date", F.when((F.col("date") > F.col("ref")) & (F.col("date") <= F.col("rep")), 1).otherwise(0).alias("code"))


def edge_matrix(pairs: DataFrame) -> DataFrame:
    """-1 at ref, 1 at rep, else 0."""
    return incidence(pairs).select("pair", "ref", "rep", "date", F.coalesce("code", F.lit(0.0)).cast("int").alias("code"))


def uncovered(pairs: DataFrame) -> DataFrame:
    """(previous date, date) for each date, but the first, that no pair covers by (ref, rep]."""
    d = dates_of(pairs)
    w = Window.orderBy("date")
    steps = d.select(F.lag("date").over(w).alias("ref"), F.col("date").alias("rep")).filter("ref IS NOT NULL")
    covered = pairs.select(F.explode(F.sequence(F.date_add("ref", 1), F.col("rep"))).alias("rep")).distinct()
    return steps.join(covered, "rep", "left_anti").select("ref", "rep").withColumn("pair", pair_name())


# ---- pair-wise data


def _parts(pairs: DataFrame, data: DataFrame, value: str) -> DataFrame:
    """For pairs made by ``extend``, both component values at each pixel."""
    made = pairs.filter("rel IS NOT NULL").select("ref", "rep", "rel")
    one = data.select("ref", "rep", "y", "x", F.col(value).alias("v"))
    first = made.join(one.select("ref", F.col("rep").alias("rel"), "y", "x", F.col("v").alias("v1")), ["ref", "rel"])
    second = one.select(F.col("ref").alias("rel"), "rep", "y", "x", F.col("v").alias("v2"))
    return first.join(second, ["rel", "rep", "y", "x"])


def extend_correlation(corr: DataFrame, pairs: DataFrame, value: str = "correlation") -> DataFrame:
    """Correlations of extended pairs: the smaller of both components (missing ones skipped)."""
    new = _parts(pairs, corr, value).select("ref", "rep", "y", "x", F.least("v1", "v2").alias(value))
    return corr.select("ref", "rep", "y", "x", value).unionByName(new).withColumn("pair", pair_name())


def extend_phase(phase: DataFrame, pairs: DataFrame, value: str = "phase", wrapped: bool = True) -> DataFrame:
    """Phases of extended pairs: the sum of both components (a missing one counts as 0), wrapped."""
    total = F.coalesce("v1", F.lit(0.0)) + F.coalesce("v2", F.lit(0.0))
    new = _parts(pairs, phase, value).select("ref", "rep", "y", "x", (wrap(total) if wrapped else total).alias(value))
    return phase.select("ref", "rep", "y", "x", value).unionByName(new).withColumn("pair", pair_name())


def fill(data: DataFrame, value: str, constant: float) -> DataFrame:
    """Adds a slice of ``constant`` over all pixels for each uncovered step (0 for phases, 1 for correlations)."""
    grid = data.select("y", "x").distinct()
    new = F.broadcast(uncovered(data.select("ref", "rep").distinct()))  # fewer rows than there are dates
    slices = grid.join(new, F.lit(True)).select("ref", "rep", "y", "x", F.lit(float(constant)).alias(value))
    return data.select("ref", "rep", "y", "x", value).unionByName(slices).withColumn("pair", pair_name())


def baseline_table(scenes: DataFrame, reference: str) -> DataFrame:
    """Parallel and perpendicular baselines of each date relative to ``reference`` (columns ``date, bpara, bperp``), rounded to 0.1."""
    ref = F.broadcast(scenes.filter(F.col("date") == F.lit(reference).cast("date")).select(F.col("bpara").alias("p0"), F.col("bperp").alias("q0")).limit(1))
    return scenes.join(ref, F.lit(True)).select("date", F.round(F.col("bpara") - F.col("p0"), 1).alias("BPL"), F.round(F.col("bperp") - F.col("q0"), 1).alias("BPR"))


def date_points(pairs: DataFrame, attribute: str | None = None) -> DataFrame:
    """Distinct (date, baseline or mean attribute) points of a network plot."""
    if attribute is None:
        return pairs.select(F.col("ref").alias("date"), F.col("ref_baseline").alias("value")).union(pairs.select(F.col("rep").alias("date"), F.col("rep_baseline").alias("value"))).distinct()
    both = pairs.select(F.col("ref").alias("date"), F.col(attribute).alias("value")).unionAll(pairs.select(F.col("rep").alias("date"), F.col(attribute).alias("value")))
    return both.groupBy("date").agg(F.avg("value").alias("value"))


def duration_bins(pairs: DataFrame, interval: int = 6, column: str | None = None) -> DataFrame:
    """Counts, or means of ``column``, by bins of durations; bins start at half an interval."""
    k = F.floor((F.col("duration") - interval / 2) / interval).cast("int")
    g = pairs.groupBy(k.alias("bin")).agg(F.count("*").alias("n"), *([F.sum(column).alias("total"), F.avg(column).alias("mean")] if column else []))
    return g.withColumn("start", F.col("bin") * interval + interval / 2)
