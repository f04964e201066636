"""The usage log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activation_stream(logs: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Hits of each block and day with a watermark: state of days that can no longer change is dropped."""
    return logs.where(F.col("block_id").isNotNull()).withWatermark("created_at", late).groupBy(F.window("created_at", window).alias("day"), "block_id").agg(F.count("*").alias("hit_count"), F.min("created_at").alias("first_hit_at"), F.max("created_at").alias("last_hit_at"))


def tool_counts_stream(logs: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Calls of each tool and day."""
    return logs.withWatermark("created_at", late).groupBy(F.window("created_at", window).alias("day"), "tool_name").agg(F.count("*").alias("calls"), F.sum("elapsed_ms").alias("elapsed_ms"))
