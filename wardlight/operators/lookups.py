"""Lookups of hosts in curated lists, snapshots and verdict caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardlight.functions.hosts import match_key
from wardlight.functions.scores import NETWORK_TTL_SECONDS, score_to_label, ttl_for_label
from wardlight.operators.bounds import broadcast_if_small


def _active(known: DataFrame) -> DataFrame:
    """One active entry per domain (the domain is unique after upserts)."""
    return (known.where("is_active").groupBy(F.lower("domain").alias("_known"))
            .agg(F.min_by(F.struct("verdict", "source"), F.struct("verdict", "source")).alias("known")))


def known_lookup(df: DataFrame, known: DataFrame, col: str = "domain") -> DataFrame:
    """Adds struct ``known`` (verdict, source), null when not listed."""
    table = broadcast_if_small(_active(known))
    return (df.withColumn("_key", match_key(F.col(col)))
            .join(table, F.col("_key") == F.col("_known"), "left").drop("_key", "_known"))


def route_verdicts(df: DataFrame, known: DataFrame, col: str = "domain") -> tuple[DataFrame, DataFrame]:
    """(rows on the curated list, rows that still need features)."""
    keys = broadcast_if_small(_active(known).select("_known"))
    keyed = df.withColumn("_key", match_key(F.col(col)))
    on = F.col("_key") == F.col("_known")
    return keyed.join(keys, on, "left_semi").drop("_key"), keyed.join(keys, on, "left_anti").drop("_key")


def known_verdict(df: DataFrame) -> DataFrame:
    """Deterministic verdict for rows carrying ``known``."""
    bad = F.col("known.verdict") != "safe"
    score = F.when(bad, 1.0).otherwise(0.0)
    text = F.concat(F.lit("This domain is on a curated threat list (source: "),
                    F.coalesce(F.nullif(F.col("known.source"), F.lit("")), F.lit("manual")), F.lit(")"))
    return df.withColumns({
        "score": score, "label": score_to_label(score), "confidence": F.lit("high"),
        "reasons": F.when(bad, F.array(text)).otherwise(F.array().cast("array<string>")),
        "cached": F.lit(False), "network_features_used": F.lit(False)}).drop("known")


def latest_before(lookups: DataFrame, obs: DataFrame, key: str, ts: str, obs_ts: str, tie: str,
                  payload: list[str], bucket_seconds: int = 3600, within_seconds: int | None = None) -> DataFrame:
    """As-of join: adds struct ``found`` (obs_ts, payload...), the newest
    observation at or before the lookup, null if none.

    With ``within_seconds`` older ones needn't be found: they aren't carried on.
    """
    reach = None if within_seconds is None else within_seconds * 1_000_000
    return as_of_join(lookups, obs, key, F.unix_micros(ts), F.unix_micros(obs_ts), tie,
                      [obs_ts, *payload], bucket_seconds * 1_000_000, reach)


def as_of_join(lookups: DataFrame, obs: DataFrame, key: str, at: Column, obs_at: Column, tie: str,
               payload: list[str], bucket_width: int, reach: int | None = None) -> DataFrame:
    """``latest_before`` over integer positions ``at`` / ``obs_at``; beyond ``reach`` nothing is carried.

    Both sides are merged and windowed per (key, bucket of positions); the
    observation carried into a bucket comes from a per-bucket aggregate, so a
    key holding a third of all rows is spread over its buckets.
    """
    left_cols, right_cols = F.struct(*lookups.columns), F.struct(*payload)
    left = lookups.select(F.col(key).alias("_k"), at.alias("_t"), F.lit(1).alias("_side"),
                          F.lit(None).cast("long").alias("_tie"), left_cols.alias("_l"))
    right = obs.select(F.col(key).alias("_k"), obs_at.alias("_t"), F.lit(0).alias("_side"),
                       F.col(tie).cast("long").alias("_tie"), right_cols.alias("found"))
    merged = left.unionByName(right, allowMissingColumns=True).withColumn(
        "_b", F.floor(F.col("_t") / F.lit(float(bucket_width))).cast("long"))
    ours = F.when(F.col("_side") == 0, F.struct("_t", "_tie"))
    newest = F.max_by(F.struct("_t", "found"), ours)
    edges = merged.groupBy("_k", "_b").agg(newest.alias("_e"), F.max("_side").alias("_asked"))
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = (edges.withColumn("_c", F.last("_e", ignorenulls=True).over(before))
               .where((F.col("_asked") == 1) & F.col("_c").isNotNull()
                      & (F.lit(True) if reach is None else F.col("_b") * bucket_width - F.col("_c._t") < reach))
               .select("_k", "_b", F.col("_c._t").alias("_t"), F.lit(-1).alias("_side"), F.col("_c.found").alias("found")))
    rows = merged.unionByName(carried, allowMissingColumns=True)
    upto = (Window.partitionBy("_k", "_b").orderBy("_t", "_side", "_tie")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (rows.withColumn("found", F.last("found", ignorenulls=True).over(upto))
            .where(F.col("_side") == 1).select("_l.*", "found"))


def latest_snapshot(lookups: DataFrame, obs: DataFrame, key: str, ts: str, obs_ts: str, tie: str,
                    payload: list[str], max_age_seconds: int = NETWORK_TTL_SECONDS) -> DataFrame:
    """As-of join that ignores observations of ``max_age_seconds`` or older."""
    joined = latest_before(lookups, obs, key, ts, obs_ts, tie, payload, within_seconds=max_age_seconds)
    age = F.unix_micros(ts) - F.unix_micros(F.col("found")[obs_ts])
    return joined.withColumn("found", F.when(age < max_age_seconds * 1_000_000, F.col("found")))


def expiry(cached_at: Column, label: Column) -> Column:
    """When a verdict stored at ``cached_at`` stops being served."""
    return F.timestamp_micros(F.unix_micros(cached_at) + ttl_for_label(label) * F.lit(1_000_000).cast("long"))


def cached_hits(reads: DataFrame, sets: DataFrame, key: str = "domain", ts: str = "ts",
                tie: str = "seq") -> DataFrame:
    """Adds ``hit`` and the served ``cached_label``: a read is a hit while the
    newest entry is inside its validity interval [cached_at, expires_at)."""
    joined = latest_before(reads, sets, key, ts, "cached_at", tie, ["label"])
    live = F.col(ts) < expiry(F.col("found.cached_at"), F.col("found.label"))
    hit = F.coalesce(live, F.lit(False))
    return joined.withColumns({"hit": hit, "cached_label": F.when(hit, F.col("found.label"))}).drop("found")


def live_entries(sets: DataFrame, now: Column, keys: tuple[str, ...] = ("domain",), tie: str = "seq") -> DataFrame:
    """Entries that would answer a read at ``now``: the newest per key, if live."""
    past = sets.where(F.col("cached_at") <= now)
    rest = [c for c in sets.columns if c not in keys]
    newest = (past.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("cached_at", tie)).alias("_r"))
              .select(*keys, "_r.*"))
    entries = newest.withColumn("expires_at", expiry(F.col("cached_at"), F.col("label")))
    return entries.where(F.col("expires_at") > now)


def bulk_probe(requests: DataFrame, sets: DataFrame, now: Column, tie: str = "seq") -> DataFrame:
    """Left-joins requested domains to the live cache in one pass."""
    live = live_entries(sets, now, tie=tie).select("domain", F.col("label").alias("cached_label"), "expires_at")
    return requests.join(live, "domain", "left").withColumn("cached", F.col("cached_label").isNotNull())


def combine_results(requests: DataFrame, *answers: DataFrame, key: str = "domain", order: str = "pos") -> DataFrame:
    """Union of answer sets (disjoint by domain) joined back to the requests, each with its place ``order``.

    Rows stand in that order inside a partition; whoever writes one request's answer sorts
    that request, not all of them.
    """
    merged = answers[0]
    for more in answers[1:]:
        merged = merged.unionByName(more)
    return requests.join(merged, key).sortWithinPartitions(order)


def payload_json(df: DataFrame, columns: list[str], out: str = "payload") -> DataFrame:
    return df.withColumn(out, F.to_json(F.struct(*columns)))


def payload_parsed(df: DataFrame, schema: str, col: str = "payload", required: str = "domain") -> DataFrame:
    """Adds ``parsed``; malformed payloads count as a miss (null)."""
    parsed = F.from_json(col, schema, {"mode": "PERMISSIVE"})
    df = df.withColumn("parsed", parsed)
    return df.withColumn("parsed", F.when(F.col("parsed")[required].isNotNull(), F.col("parsed")))
