"""Streams of scans: tumbling windows and sessions with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(stream: DataFrame, keys: list[str], time: str = "ts", value: str = "value", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and extremes of each key and window; works on a stream and on a table."""
    timed = stream.withColumn("_t", F.col(time).cast("timestamp"))
    timed = timed.withWatermark("_t", late) if stream.isStreaming else timed
    out = timed.groupBy(F.window("_t", width).alias("w"), *keys).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(*keys, F.col("w.start").alias("start"), "n", "low", "high")


def sessions(stream: DataFrame, keys: list[str], time: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a key's rows with no gap over ``gap``."""
    timed = stream.withColumn("_t", F.col(time).cast("timestamp"))
    timed = timed.withWatermark("_t", late) if stream.isStreaming else timed
    out = timed.groupBy(F.session_window("_t", gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")
