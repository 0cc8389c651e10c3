"""Structured Streaming over the event table, replayed to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import checkpoint_dir


def _place(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf: str, lateness: str = "1 hour") -> DataFrame:
    """Events as a stream with event time `at`; what comes later than `lateness` behind is late data."""
    # A pattern takes a table of one file as well as a folder of files.
    path = f"{sf}/event[s].parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(path)
    return stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)


def windowed_counts(spark: SparkSession, sf: str, width: str = "1 day") -> DataFrame:
    """Counts and totals per event type and tumbling window, as the finished stream leaves them.

    Each trigger writes the windows it changed; the last version of a window
    holds, so open windows at the end of the stream are not lost.
    """
    place = _place(spark, "windows")
    agg = event_stream(spark, sf).groupBy("event_type", F.window("at", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    flat = agg.select("event_type", F.col("w.start").alias("start"), "n", "total")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{place}/data/batch={number}")

    flat.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    versions = spark.read.schema("event_type string, start timestamp, n long, total double, version int").parquet(f"{place}/data/*")
    last = versions.groupBy("event_type", "start").agg(F.max_by(F.struct("n", "total"), "version").alias("r"))
    return last.select("event_type", F.col("start").cast("timestamp_ntz").alias("day"), "r.n", F.round("r.total", 4).alias("total"))


def first_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """Events per user and type, each event id once: repeats within the watermark are dropped on the stream."""
    place = _place(spark, "once")
    once = event_stream(spark, sf).dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id", "event_type")
    once.writeStream.outputMode("append").format("parquet").option("path", f"{place}/data").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("event_id long, user_id long, event_type string").parquet(f"{place}/data")
    return rows.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
