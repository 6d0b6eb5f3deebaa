"""Sessions of messages: runs without a gap longer than a limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrillo.functions.times import boundary_minutes
from corrillo.operators.ordering import ROWS_PER_RANGE, previous, running


def summary_columns() -> list[Column]:
    """First and last time, messages, people, first and last sender (ties by message_id) of a session."""
    at = F.struct("timestamp", "message_id")
    return [
        F.min("timestamp").alias("started"), F.max("timestamp").alias("ended"), F.count("*").alias("messages"), F.count_distinct("sender").alias("people"),
        F.min_by("sender", at).alias("opener"), F.max_by("sender", at).alias("closer"),
    ]


def of_everybody(messages: DataFrame, gap: str, per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Sessions over all messages: gaps and session numbers run along ranges of the timeline, many tasks wide."""
    order = ["timestamp", "message_id"]
    steps = previous(messages, order, ["timestamp"], per_range, keep=True)
    fresh = F.coalesce(F.col("timestamp") - F.col("previous_timestamp") > F.expr(f"INTERVAL {gap}"), F.lit(True))
    numbered = running(steps, order, fresh.cast("long"), "session", per_range)
    return numbered.groupBy("session").agg(*summary_columns()).drop("session").withColumn("minutes", boundary_minutes("started", "ended"))


def by_lag(messages: DataFrame, gap: str, key: str) -> DataFrame:
    """Sessions of each key by gaps and a running sum, with their number from 1."""
    order = Window.partitionBy(key).orderBy("timestamp", "message_id")
    fresh = F.coalesce(F.col("timestamp") - F.lag("timestamp").over(order) > F.expr(f"INTERVAL {gap}"), F.lit(True))
    numbered = messages.withColumn("fresh", fresh.cast("int")).withColumn("session", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(*summary_columns()).withColumn("minutes", boundary_minutes("started", "ended"))
