"""Scenes, pairs and stacks made from the driver's tables, and the same as SQL for comparison.

All rows of ``events`` go in. Sums are over whole 64ths, which doubles hold exactly in any order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringework.functions.columns import wrap
from fringework.operators import pairs as P
from fringework.shared import table

DAYS, METERS = 6, 60
PI = f"{math.pi!r}e0"
TAU = f"{2 * math.pi!r}e0"


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff("date", F.lit("2024-01-01").cast("date"))
    return table(spark, sf_dir, "events").select(F.to_date("ts").alias("date")).distinct().select("date", (day * 37 % 101 - 50).cast("double").alias("bperp"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.make_pairs(scenes(spark, sf_dir), DAYS, METERS)


def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.to_date("ts").alias("date"), (F.col("user_id") % 12).cast("double").alias("y"), (F.col("event_id") % 10).cast("double").alias("x")).agg((F.sum(F.floor(F.col("value") * 64)).cast("double") / 64).alias("v"))


def slc(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.to_date("ts").alias("date"), (F.col("user_id") % 12).cast("double").alias("y"), (F.col("event_id") % 10).cast("double").alias("x")).agg((F.sum(F.floor(F.col("value") * 64)).cast("double") / 64 + 1).alias("re"), F.sum(F.col("event_id") % 97 - 48).cast("double").alias("im"))


def pair_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ref, rep, pair, y, x, phase, correlation`` of each pair where both scenes have the pixel."""
    s = stack(spark, sf_dir)
    p = F.broadcast(pairs(spark, sf_dir).select("ref", "rep", "pair"))  # as many rows as the network
    one = s.select(F.col("date").alias("ref"), "y", "x", F.col("v").alias("v1"))
    two = s.select(F.col("date").alias("rep"), "y", "x", F.col("v").alias("v2"))
    d = F.col("v2") - F.col("v1")
    return one.join(p, "ref").join(two, ["rep", "y", "x"]).select("ref", "rep", "pair", "y", "x", wrap(d * 0.05).alias("phase"), (1.0 / (1.0 + F.abs(d) / 64.0)).alias("correlation"))


def total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One grid: the sum of the stack over dates."""
    return stack(spark, sf_dir).groupBy("y", "x").agg(F.sum("v").alias("v"))


def wrapped_sql(x: str) -> str:
    return f"((({x}) + {PI}) - {TAU} * floor((({x}) + {PI}) / {TAU})) - {PI}"


NAME = "strftime(ref, '%Y-%m-%d') || ' ' || strftime(rep, '%Y-%m-%d')"
BASE = f"""
WITH RECURSIVE scenes AS (SELECT DISTINCT CAST(ts AS DATE) AS date, CAST((date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 37) % 101 - 50 AS DOUBLE) AS bperp FROM events),
pairs AS (SELECT *, {NAME} AS pair FROM (SELECT a.date AS ref, b.date AS rep, round(a.bperp, 2) AS ref_baseline, round(b.bperp, 2) AS rep_baseline, round(b.bperp - a.bperp, 2) AS baseline,
  CAST(date_diff('day', a.date, b.date) AS INTEGER) AS duration, CAST(NULL AS DATE) AS rel
  FROM scenes a JOIN scenes b ON a.date < b.date AND date_diff('day', a.date, b.date) < {DAYS + 1} AND abs(a.bperp - b.bperp) < {METERS + 1})),
stack AS (SELECT CAST(ts AS DATE) AS date, CAST(user_id % 12 AS DOUBLE) AS y, CAST(event_id % 10 AS DOUBLE) AS x, CAST(sum(floor(value * 64)) AS DOUBLE) / 64 AS v FROM events GROUP BY ALL),
slc AS (SELECT CAST(ts AS DATE) AS date, CAST(user_id % 12 AS DOUBLE) AS y, CAST(event_id % 10 AS DOUBLE) AS x, CAST(sum(floor(value * 64)) AS DOUBLE) / 64 + 1 AS re, CAST(sum(event_id % 97 - 48) AS DOUBLE) AS im FROM events GROUP BY ALL),
data AS (SELECT p.ref, p.rep, p.pair, a.y, a.x, {wrapped_sql("(b.v - a.v) * 0.05e0")} AS phase, 1e0 / (1e0 + abs(b.v - a.v) / 64e0) AS correlation
  FROM pairs p JOIN stack a ON a.date = p.ref JOIN stack b ON b.date = p.rep AND b.y = a.y AND b.x = a.x),
total AS (SELECT y, x, sum(v) AS v FROM stack GROUP BY y, x),
dates AS (SELECT DISTINCT date FROM (SELECT ref AS date FROM pairs UNION ALL SELECT rep FROM pairs))
"""
