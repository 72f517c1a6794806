"""Windowed reports that run unchanged on batch and streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Requests allowed per minute, by endpoint.
LIMITS_PER_MINUTE = {"analyze": 60, "bulk": 10, "feedback": 20}
DEFAULT_LIMIT = 100
LATENESS = "10 minutes"


def watermarked(df: DataFrame, ts: str, delay: str | None = LATENESS) -> DataFrame:
    """A watermark on streams; batch frames pass through."""
    return df.withWatermark(ts, delay) if df.isStreaming and delay else df


def rate_limit_report(calls: DataFrame, delay: str | None = LATENESS) -> DataFrame:
    """Requests per endpoint, key and fixed minute, and whether too many."""
    counts = watermarked(calls, "ts", delay).groupBy(F.window("ts", "1 minute").alias("w"), "endpoint", "api_key").agg(
        F.count("*").alias("n"))
    allowed = F
    for endpoint, limit in LIMITS_PER_MINUTE.items():
        allowed = allowed.when(F.col("endpoint") == endpoint, limit)
    return counts.select("endpoint", "api_key", F.col("w.start").alias("minute"), "n",
                         (F.col("n") > allowed.otherwise(DEFAULT_LIMIT)).alias("over_limit"))


def label_counts(log: DataFrame, width: str = "1 hour", slide: str | None = None,
                 ts: str = "created_at", delay: str | None = LATENESS) -> DataFrame:
    """Verdicts per label in tumbling (or sliding) windows."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    counts = watermarked(log, ts, delay).groupBy(window.alias("w"), "label").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("started_at"), "label", "n")
