"""An extension: tumbling-window totals of the events table, as a stream or as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Count and value by window and type; rows later than the watermark are dropped when events is a stream."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
