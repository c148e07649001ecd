"""Streaming forms: segment timelines and activity sessions over an event stream with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def stamped(events: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Watermarks need a zoned timestamp."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def segment_stream(events: DataFrame, key: str, value: str, size: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Level of each closed tumbling window: ``key, start, n, rms, peak``."""
    g = stamped(events, ts, late).groupBy(key, F.window(ts, size).alias("w"))
    out = g.agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.max(F.abs(value)).alias("peak"))
    return out.select(key, F.col("w.start").alias("start"), "n", "rms", "peak")


def session_stream(events: DataFrame, key: str, gap: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    g = stamped(events, ts, late).groupBy(key, F.session_window(ts, gap).alias("w"))
    return g.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")
