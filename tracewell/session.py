"""Session settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    """UTC, adaptive execution with skew handling, and recursion limits that raise instead of running on."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.cteRecursionLevelLimit": "100",
    }
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder
