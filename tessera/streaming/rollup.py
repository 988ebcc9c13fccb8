"""Windowed statistics of an event stream, the same expressions for a stream and for a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_rollup(events: DataFrame, time: str = "ts", key: str = "event_type", value: str = "value", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """``window_start``, key, ``n``, ``total`` of each tumbling window; streams drop what comes later than ``late``."""
    timed = events.withColumn("__t", F.col(time).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("__t", late)
    out = timed.groupBy(F.window("__t", width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), key, "n", "total")
