"""Streaming extras: sessions and windows of an event stream, with late data behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Events from files that arrive in a folder. Their times have no zone; a watermark needs one (the session's, UTC)."""
    s = spark.readStream.schema(EVENTS).parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): sessions that end when a user is silent for ``gap``; rows later than ``late`` are dropped.

    Works on a stream and, with the same result but for sessions still open, on a table."""
    w = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def per_window(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total): tumbling windows."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run(df: DataFrame, to: str, checkpoint: str) -> None:
    """Process what is there and stop; every result row is appended once, also after a restart."""
    df.writeStream.outputMode("append").format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
