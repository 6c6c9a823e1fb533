"""The visit log as a stream: windows, sessions and silence. Our own addition; late rows follow the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DELAY = "2 days"


def per_window(visits: DataFrame, clock: str = "created_at", size: str = "1 day", delay: str = DELAY) -> DataFrame:
    """start, facet, status, visits, tokens in tumbling windows; rows later than the watermark are left out on a stream."""
    timed = visits.withColumn("at", F.col(clock).cast("timestamp")).where("at IS NOT NULL").withWatermark("at", delay)
    counted = timed.groupBy(F.window("at", size).alias("w"), "facet", "status").agg(F.count("*").alias("visits"), F.coalesce(F.sum("tokens_total"), F.lit(0)).cast("bigint").alias("tokens"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "facet", "status", "visits", "tokens")


def sessions(visits: DataFrame, clock: str = "created_at", gap: str = "6 hours", delay: str = DELAY) -> DataFrame:
    """record, start, end, visits: readings of a record that follow each other within the gap."""
    timed = visits.withColumn("at", F.col(clock).cast("timestamp")).where("at IS NOT NULL").withWatermark("at", delay)
    counted = timed.groupBy(F.session_window("at", gap).alias("w"), "tendable_type", "tendable_id").agg(F.count("*").alias("visits"))
    return counted.select("tendable_type", "tendable_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "visits")


def once(visits: DataFrame, clock: str = "created_at", delay: str = DELAY) -> DataFrame:
    """Each delivered row's first arrival within the watermark: repeats of an id are dropped."""
    timed = visits.withColumn("at", F.col(clock).cast("timestamp")).where("at IS NOT NULL").withWatermark("at", delay)
    return timed.dropDuplicatesWithinWatermark(["id"]).drop("at")


def to_table(frame: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Write a stream's finished windows as parquet, as far as there is input now."""
    return frame.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
