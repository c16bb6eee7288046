"""Replays an event table as a stream, to its end, and returns the counts per type that the stream arrived at."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, delay: str = "2 days", width: str = "1 day") -> DataFrame:
    """Counts and sums per event type and day; rows later than ``delay`` behind the newest are dropped by the stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def replay_counts(spark: SparkSession, path: str) -> DataFrame:
    """Reads every file under ``path`` through a stream (``availableNow``) into memory: one row per day and type."""
    source = spark.read.parquet(path)
    # a stream watches a folder; a table in one file is named by its own pattern
    stream = spark.readStream.schema(source.schema).parquet(f"{path.rsplit('/', 1)[0]}/{path.rsplit('/', 1)[1]}*")
    name = f"replay_{uuid.uuid4().hex}"
    query = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))
