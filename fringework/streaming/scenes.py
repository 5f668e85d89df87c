"""Catalogs that grow: new scenes make new pairs, new samples new slices, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from fringework.operators import pairs
from fringework.sources.store import Store


def watch(spark: SparkSession, folder: str, schema: StructType, watermark: str = "30 days") -> DataFrame:
    """Scenes (date, bperp, ...) as files arrive; a scene that comes again within the watermark is dropped."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.withColumn("_at", F.col("date").cast("timestamp")).withWatermark("_at", watermark).dropDuplicatesWithinWatermark(["date"]).drop("_at")


def extend_network(scenes: DataFrame, store: Store, days: int, meters: float | None, checkpoint: str) -> StreamingQuery:
    """Keeps the table ``network`` of a store: each batch's scenes pair with those known and with each other. A batch that is
    run again replaces its own rows, so a restart leaves nothing twice."""

    def batch(new: DataFrame, number: int) -> None:
        own = new.select("date", "bperp").withColumn("batch", F.lit(number))
        store.save_stack(own, "known", "batch")
        known = store.open_stack("known", key="batch").filter(F.col("batch") <= number)
        all_pairs = pairs.make_pairs(known, days, meters)
        fresh = own.select("date")
        touched = all_pairs.join(fresh.withColumnRenamed("date", "ref"), "ref", "left_semi").unionByName(all_pairs.join(fresh.withColumnRenamed("date", "rep"), "rep", "left_semi")).distinct()
        store.save_stack(touched.withColumn("batch", F.lit(number)), "network", "batch")

    return scenes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_means(samples: DataFrame, value: str, length: str = "12 days", late: str = "6 days") -> DataFrame:
    """Means of samples (ts, y, x, value) by windows of time, for a stream whose rows may be late."""
    return samples.withWatermark("ts", late).groupBy(F.window("ts", length), "y", "x").agg(F.avg(value).alias(value), F.count("*").alias("n"))
