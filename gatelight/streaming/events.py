"""Structured Streaming: windows over events, sessions, dedupe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """A folder's Parquet files of one schema as a stream."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(path)


def watermarked(events: DataFrame, late: str) -> DataFrame:
    """Streams get a watermark, for which ts must have a time zone; batches stay as they are."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums of value by window and event_type; tumbling unless slide is given."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    base = watermarked(events, late)
    got = base.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return got.select(F.col("w.start").alias("win_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of each user, closed after `gap` without events."""
    base = watermarked(events, late)
    got = base.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return got.select("user_id", F.col("w.start").alias("session_start"), "n")


def first_of_key(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once, as far as the watermark remembers."""
    if events.isStreaming:
        return watermarked(events, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)
