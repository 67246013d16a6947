"""Windows over a stream of events (extensions beyond the graph). The same expressions serve batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, every: str = "1 hour") -> DataFrame:
    """Events and their value by type and window."""
    grouped = events.groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("events"), F.sum(F.floor(F.col("value") * 100)).cast("long").alias("cents"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "events", "cents")


def sliding(events: DataFrame, size: str = "6 hours", step: str = "3 hours") -> DataFrame:
    return events.groupBy(F.window("ts", size, step)).agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), "events")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of a user's events with no longer pause than `gap`."""
    grouped = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"))
    return grouped.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def stream(spark: SparkSession, folder: str, schema, late: str = "1 hour", pattern: str = "events*.parquet") -> DataFrame:
    """Tumbling windows over Parquet files as they arrive; events later than `late` are left out."""
    events = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    return tumbling(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late))
