"""Batch operators on unbounded input: keyword tags and token counts of a stream of utterances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, key: str, value: Column, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum per key and event-time window. Rows later than ``late`` are dropped, so state is bounded. Works on
    streams and on tables."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")
