"""Conversations as sessions between pauses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corrillo.operators.sessions import by_lag, of_everybody
from corrillo.plans.base import query, timeline

_RUNS = """
steps AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL {gap}, true) AS fresh FROM events WINDOW w AS ({part} ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(fresh::INT) OVER ({part} ORDER BY ts, event_id) AS session FROM steps),
sessions AS (
    SELECT {key} session, min(ts) AS started, max(ts) AS ended, count(*) AS messages, count(DISTINCT user_id) AS people,
           arg_min(user_id, (ts, event_id)) AS opener, arg_max(user_id, (ts, event_id)) AS closer, date_diff('minute', min(ts), max(ts)) AS minutes
    FROM numbered GROUP BY ALL)
"""
_GLOBAL = "WITH " + _RUNS.format(gap="10 MINUTE", part="", key="")
#: Upper bounds (fixed values) of the histogram bins.
SIZES = ((1, "1"), (2, "2"), (5, "3-5"), (10, "6-10"), (20, "11-20"), (50, "21-50"), (100, "51-100"))
LENGTHS = ((1, "<1"), (5, "1-4"), (10, "5-9"), (20, "10-19"), (30, "20-29"), (60, "30-59"), (120, "60-119"))


def global_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_everybody(timeline(spark, sf_dir), "'10' MINUTE")


def binned(value: Column, bounds, last: str, strict: bool = False) -> Column:
    found = None
    for bound, label in bounds:
        inside = value < bound if strict else value <= bound
        found = F.when(inside, label) if found is None else found.when(inside, label)
    return found.otherwise(last)


def _case(value: str, bounds, last: str, op: str) -> str:
    return "CASE " + " ".join(f"WHEN {value} {op} {b} THEN '{label}'" for b, label in bounds) + f" ELSE '{last}' END"


@query("WITH " + _RUNS.format(gap="12 HOUR", part="PARTITION BY user_id", key="user_id AS sender,") + "SELECT sender, CAST(session AS BIGINT) AS session, started, ended, messages, people, opener, closer, minutes FROM sessions")
def sessions_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_lag(timeline(spark, sf_dir).withColumn("key", F.col("sender")), "'12' HOUR", "key").withColumnRenamed("key", "sender")


@query(_GLOBAL + "SELECT started, ended, messages, people, opener, closer, minutes FROM sessions")
def session_window_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return global_sessions(spark, sf_dir)


@query(_GLOBAL + """
SELECT count(*) AS sessions, count(*) FILTER (messages = 1) AS alone, round(median(messages), 4) AS median_messages, max(messages) AS most_messages,
       round(median(minutes) FILTER (messages > 1), 4) AS median_minutes, max(minutes) AS most_minutes, round(median(people), 4) AS median_people
FROM sessions""")
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return global_sessions(spark, sf_dir).agg(
        F.count("*").alias("sessions"), F.count_if(F.col("messages") == 1).alias("alone"), F.round(F.median("messages"), 4).alias("median_messages"), F.max("messages").alias("most_messages"),
        F.round(F.median(F.when(F.col("messages") > 1, F.col("minutes"))), 4).alias("median_minutes"), F.max("minutes").alias("most_minutes"), F.round(F.median("people"), 4).alias("median_people"))


@query(_GLOBAL + """
, senders AS (SELECT user_id AS sender, count(*) AS messages FROM events GROUP BY user_id),
opens AS (SELECT opener AS sender, count(*) AS n FROM sessions GROUP BY opener), closes AS (SELECT closer AS sender, count(*) AS n FROM sessions GROUP BY closer)
SELECT sender, messages, coalesce(opens.n, 0) AS opens, coalesce(closes.n, 0) AS closes,
       round(1000.0 * coalesce(opens.n, 0) / messages, 4) AS opens_per_mille, round(1000.0 * coalesce(closes.n, 0) / messages, 4) AS closes_per_mille
FROM senders LEFT JOIN opens USING (sender) LEFT JOIN closes USING (sender)""")
def openers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who opens and closes sessions; all three sides are one row per sender."""
    found = global_sessions(spark, sf_dir)
    senders = timeline(spark, sf_dir).groupBy("sender").agg(F.count("*").alias("messages"))
    opens, closes = (found.groupBy(F.col(c).alias("sender")).agg(F.count("*").alias(n)) for c, n in (("opener", "opens"), ("closer", "closes")))
    joined = senders.join(opens, "sender", "left").join(closes, "sender", "left").na.fill(0, ["opens", "closes"])
    return joined.withColumns({f"{n}_per_mille": F.round(1000.0 * F.col(n) / F.col("messages"), 4) for n in ("opens", "closes")})


@query(_GLOBAL + f"SELECT {_case('messages', SIZES, '>100', '<=')} AS size, count(*) AS sessions FROM sessions GROUP BY 1")
def session_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return global_sessions(spark, sf_dir).groupBy(binned(F.col("messages"), SIZES, ">100").alias("size")).agg(F.count("*").alias("sessions"))


@query(_GLOBAL + f"SELECT {_case('minutes', LENGTHS, '>=120', '<')} AS length, count(*) AS sessions FROM sessions WHERE messages > 1 GROUP BY 1")
def session_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = global_sessions(spark, sf_dir).where("messages > 1")
    return found.groupBy(binned(F.col("minutes"), LENGTHS, ">=120", strict=True).alias("length")).agg(F.count("*").alias("sessions"))
