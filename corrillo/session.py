"""The engine's session; on a cluster, submit-time settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "corrillo") -> SparkSession:
    return (
        SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate()
    )
