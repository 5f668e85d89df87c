"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringework import shared


def stars(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node that isn't its component's smallest one. edges: long columns ``a, b``, any orientation.

    Loops and repeated edges are harmless; nulls are ignored. Each round is written to the shared folder.
    """
    spark = edges.sparkSession
    now = shared.materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        # The minima are written so that the joins see two plain tables, whose skewed keys Spark can split.
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(now.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = shared.materialise(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("lo"), F.least("u", "m").alias("m")), "least")
        large = shared.materialise(now.join(least, "lo").select("hi", F.col("m").alias("lo")).distinct(), "large")
        below = shared.materialise(large.groupBy("hi").agg(F.min("lo").alias("m")), "below")
        joined = large.join(below, "hi")
        small = joined.select(F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*").filter("hi <> lo").distinct()
        after = shared.materialise(small, "small")
        for t in (least, large, below, now):
            shared.drop_table(spark, t)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    out = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    out._table = now._table  # so that ``drop_table`` takes it
    return out


def _mark(edges: DataFrame) -> tuple[int, int]:
    """A number of edges and a sum of their hashes: equal only if a round changed nothing."""
    r = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return r.n, int(r.h)
