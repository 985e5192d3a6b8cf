"""Streaming forms: tumbling windows with a watermark, and dropping records seen before.

The same functions work on batch tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, minutes: int = 60, late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) per window; events later than the watermark are dropped on streams."""
    timed = events.withColumn("time", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("time", late)
    out = timed.groupBy(F.window("time", f"{minutes} minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def unseen(records: DataFrame, keys: list[str], late: str = "7 days") -> DataFrame:
    """Records whose keys are new within the watermark."""
    timed = records.withColumn("time", F.col("ts").cast("timestamp"))
    if records.isStreaming:
        return timed.withWatermark("time", late).dropDuplicatesWithinWatermark(keys).drop("time")
    return records.dropDuplicates(keys)
