"""Structured Streaming over events: sessions, windowed counts, de-duplication within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of event files, with ts as timestamp."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Rows of each user's sessions; works on a stream and on a table."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def window_counts(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    w = F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
