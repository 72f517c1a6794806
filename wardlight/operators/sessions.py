"""Sessions of visits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardlight.functions.scores import TTL_SECONDS


def visit_sessions(visits: DataFrame, gap_seconds: int = TTL_SECONDS["safe"], key: str = "domain",
                   ts: str = "ts") -> DataFrame:
    """Sessions per key separated by gaps of at least ``gap_seconds``.

    Visits inside one gap-wide slot can never be split, so slots are
    aggregated first; the windows then see at most one row per slot.
    """
    gap = gap_seconds * 1_000_000
    t = F.unix_micros(ts)
    slots = visits.groupBy(key, F.floor(t / F.lit(float(gap))).alias("_slot")).agg(
        F.min(t).alias("_first"), F.max(t).alias("_last"), F.count("*").alias("_n"))
    order = Window.partitionBy(key).orderBy("_slot")
    starts = slots.withColumn("_new", (F.coalesce(F.col("_first") - F.lag("_last").over(order), F.lit(gap)) >= gap).cast("int"))
    numbered = starts.withColumn("session", F.sum("_new").over(order))
    return numbered.groupBy(key, "session").agg(
        F.timestamp_micros(F.min("_first")).alias("started_at"),
        F.timestamp_micros(F.max("_last")).alias("ended_at"), F.sum("_n").alias("visits"))
