"""Sessions of a stream of messages, closed once the watermark has passed their gap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sessions(messages: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "sender") -> DataFrame:
    """started, ended, messages per key of a streaming frame with `timestamp` (with time zone); append mode."""
    window = F.session_window("timestamp", gap)
    found = messages.withWatermark("timestamp", late).groupBy(key, window.alias("w")).agg(F.count("*").alias("messages"), F.max("timestamp").alias("ended"))
    return found.select(key, F.col("w.start").alias("started"), "ended", "messages")
