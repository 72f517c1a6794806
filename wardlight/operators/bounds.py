"""Size-checked broadcasting and time-bucketed order-dependent helpers.

A broadcast side is always counted first (the count stops one row past the
limit); a larger side is joined by Spark's own choice of shuffle join.

Order-dependent work per key (previous value, as-of lookups) never puts a whole
key into one task: rows are windowed per (key, time bucket) and the value
carried in from earlier buckets comes from a small per-bucket aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BROADCAST_ROWS = 200_000
LITERAL_ROWS = 2_000


def fits(df: DataFrame, max_rows: int) -> bool:
    """Whether the frame has at most ``max_rows`` rows."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if fits(df, max_rows) else df


def literal_values(df: DataFrame, column: str, max_rows: int = LITERAL_ROWS) -> list | None:
    """Distinct values of a small dimension column, or None when too many."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(max_rows + 1).collect()
    return sorted(r[0] for r in rows) if len(rows) <= max_rows else None


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns behind a one-row ``inline``.

    A filter on such a column runs after it is computed.  With a plain
    projection the optimizer would push the filter down by pasting the whole
    expression into it, once per mention.  Map-only, inside codegen.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))


def time_bucket(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(float(seconds * 1_000_000))).cast("long")


def _order_key(order: list[str]) -> Column:
    return F.struct(*order)


def previous_value(df: DataFrame, key: str, ts: str, tie: str, value: str, out: str,
                   bucket_seconds: int = 3600) -> DataFrame:
    """``lag(value)`` per key in (ts, tie) order, split by time bucket."""
    return _shifted(df, key, ts, tie, value, out, bucket_seconds, forward=False)


def next_value(df: DataFrame, key: str, ts: str, tie: str, value: str, out: str,
               bucket_seconds: int = 3600) -> DataFrame:
    """``lead(value)`` per key in (ts, tie) order, split by time bucket."""
    return _shifted(df, key, ts, tie, value, out, bucket_seconds, forward=True)


def _shifted(df, key, ts, tie, value, out, bucket_seconds, forward):
    work = df.withColumn("_b", time_bucket(F.col(ts), bucket_seconds))
    wrapped = F.struct(F.col(value).alias("v"))
    pick = F.min_by if forward else F.max_by
    edge = work.groupBy(key, "_b").agg(pick(wrapped, _order_key([ts, tie])).alias("_e"))
    shift = F.lead if forward else F.lag
    edge = edge.select(key, "_b", shift("_e").over(Window.partitionBy(key).orderBy("_b")).alias("_c"))
    inside = Window.partitionBy(key, "_b").orderBy(ts, tie)
    joined = work.join(edge, [key, "_b"])
    return joined.withColumn(out, F.coalesce(shift(wrapped).over(inside), F.col("_c"))["v"]).drop("_b", "_c")


def running_total(df: DataFrame, by: list[str], score: str, counts: list[str],
                  descending: bool = True) -> DataFrame:
    """Cumulative counts over distinct scores in [0, 1], inclusive.

    Three levels of fixed score buckets keep every window small: whole buckets
    of 2^-12, sub-buckets of 2^-24, then the distinct scores inside one.
    """
    work = (df.withColumn("_hi", F.floor(F.col(score) * F.lit(4096.0)).cast("long"))
            .withColumn("_lo", F.floor(F.col(score) * F.lit(16777216.0)).cast("long")))
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())

    def before(frame, part, order, cols):
        w = (Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))).orderBy(way(order))
        w = w.rowsBetween(Window.unboundedPreceding, -1)
        return frame.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_p_{c}") for c in cols])

    low = work.groupBy(*by, "_hi", "_lo").agg(*[F.sum(c).alias(c) for c in counts])
    high = low.groupBy(*by, "_hi").agg(*[F.sum(c).alias(c) for c in counts])
    high = before(high, by, "_hi", counts).select(
        *by, "_hi", *[F.col(f"_p_{c}").alias(f"_h_{c}") for c in counts])
    low = before(low, [*by, "_hi"], "_lo", counts).join(high, [*by, "_hi"]).select(
        *by, "_hi", "_lo",
        *[(F.col(f"_p_{c}") + F.col(f"_h_{c}")).alias(f"_base_{c}") for c in counts])
    inside = (Window.partitionBy(*by, "_hi", "_lo").orderBy(way(score))
              .rowsBetween(Window.unboundedPreceding, 0))
    return work.join(low, [*by, "_hi", "_lo"]).select(
        *df.columns,
        *[(F.sum(c).over(inside) + F.col(f"_base_{c}")).alias(f"cum_{c}") for c in counts])
