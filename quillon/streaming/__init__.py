"""Extensions for event streams; the core is a batch engine.

Each works on a streaming and on a static DataFrame alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, every: str, *by: str, late: str = "10 minutes", time: str = "ts", value: str = "value") -> DataFrame:
    """Count and sum in windows of fixed length; rows later than ``late`` are dropped from a stream."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    w = F.window(time, every)
    return events.groupBy(w, *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def sliding(events: DataFrame, length: str, step: str, *by: str, late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Count in windows that overlap."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    return events.groupBy(F.window(time, length, step), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def sessions(events: DataFrame, gap: str, *by: str, late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Runs of events of which each follows the last within the gap."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    return events.groupBy(F.session_window(time, gap), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")
