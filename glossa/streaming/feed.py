"""A live feed: windows over scores and events, late rows by watermark, repeated texts once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_averages(rows: DataFrame, time: str = "ts", value: str = "value", key: str = "event_type", length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and mean of ``value`` by tumbling window and key; works on streams and tables."""
    grouped = rows.withWatermark(time, late).groupBy(F.window(time, length), key)
    return grouped.agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean")).select(F.col("window.start").alias("window_start"), key, "n", "mean")


def sessions(rows: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a key, parted by a gap."""
    grouped = rows.withWatermark(time, late).groupBy(F.session_window(time, gap), key)
    return grouped.agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("session_start"), key, "n")


def new_texts(rows: DataFrame, time: str = "ts", text: str = "text", late: str = "2 hours") -> DataFrame:
    """Each text once within the watermark, by its digest."""
    keyed = rows.withColumn("sha256", F.sha2(F.encode(text, "UTF-8"), 256)).withWatermark(time, late)
    return keyed.dropDuplicatesWithinWatermark(["sha256"])
