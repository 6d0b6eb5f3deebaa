"""Registration of queries, and the adaptor frames that they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: What lies between the words of the default tokenizer: anything but letters.
BETWEEN = r"\P{L}+"


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows, if any can."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages: message_id, timestamp, sender, message_type, n_words."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("message_id"), F.col("ts").alias("timestamp"), F.col("user_id").alias("sender"), F.col("event_type").alias("message_type"), F.col("value").alias("n_words"))


def word_list(text: Column | str) -> Column:
    """The words of a text; a split leaves an empty string before a first and after a last separator."""
    return F.array_remove(F.split(text, BETWEEN), "")


def words(frame: DataFrame, *keys: str) -> DataFrame:
    """keys and token, a row per word of frame.text in lower case.

    An outer explode, as the optimiser would add a filter below an inner one that cuts every text a second time.
    """
    return frame.select(*keys, F.explode_outer(word_list(F.lower("text"))).alias("token")).where("token IS NOT NULL")


def per_group(uses: Column, test: Column) -> Column:
    """A filter on the keys of an aggregation that is evaluated after it, once per group and not once per row.

    As it depends on a count, the optimiser cannot push it below the aggregation.
    """
    return F.when(uses > 0, test).otherwise(F.lit(False))
