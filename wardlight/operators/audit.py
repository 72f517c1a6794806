"""The verdict log, curated list, model registry and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions.scores import SUSPICIOUS_AT, ttl_remaining
from wardlight.operators.bounds import broadcast_if_small

MAX_RECENT = 500
RETENTION_DAYS = 90


def log_gate(df: DataFrame) -> DataFrame:
    """Only flagged verdicts are logged."""
    return df.where(F.col("score") >= SUSPICIOUS_AT)


def log_rows(df: DataFrame) -> DataFrame:
    """Stored form of a verdict."""
    return df.withColumns({"domain": F.lower("domain"), "score": F.round("score", 6)})


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write per key: one aggregate, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*[F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in df.columns])


def upsert(current: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``new`` replaces rows of ``current`` with the same key."""
    tagged = current.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest_per_key(tagged, keys, ["_new", *order]).drop("_new")


def upsert_non_null(df: DataFrame, key: str, order: str) -> DataFrame:
    """Registry merge: per column the last value that was given."""
    def newest(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col(order))).alias(name)

    return df.groupBy(key).agg(*[newest(c) for c in df.columns if c not in (key, order)])


def promote(registry: DataFrame, version: str, deployed_at: Column) -> DataFrame:
    """Demotes everything, then promotes ``version``; an unknown version
    leaves no production model."""
    chosen = F.col("version") == version
    stamp = F.col("deployed_at") if "deployed_at" in registry.columns else F.lit(None).cast("timestamp")
    return registry.withColumns({
        "is_production": chosen, "deployed_at": F.when(chosen, deployed_at).otherwise(stamp)})


def production_model(registry: DataFrame) -> DataFrame:
    return registry.where("is_production")


def purge_older_than(log: DataFrame, as_of: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows that stay: created at or after the cutoff."""
    return log.where(F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days)))


def purge_count(log: DataFrame, as_of: Column, days: int = RETENTION_DAYS) -> DataFrame:
    old = F.col("created_at") < as_of - F.make_dt_interval(F.lit(days))
    return log.agg(F.count_if(old).alias("purged"), F.count_if(~old).alias("kept"))


def analysis_stats(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count("*").alias("total_logged"),
        F.count_if(F.col("label") == "suspicious").alias("suspicious_count"),
        F.count_if(F.col("label") == "malicious").alias("malicious_count"),
        F.max("created_at").alias("latest_analysis_at"))


def top_malicious(log: DataFrame, k: int = 10) -> DataFrame:
    """Most often logged malicious domains (ties by name)."""
    return (log.where(F.col("label") == "malicious").groupBy("domain").agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "domain").limit(k))


def recent_analyses(log: DataFrame, limit: int = 50, label: str | None = None, tie: str = "domain",
                    most: int = MAX_RECENT) -> DataFrame:
    """The ``limit`` newest, newest first; only flagged labels may be asked for.

    A ``limit`` above ``most`` raises: no caller gets fewer rows than asked for.
    """
    if limit > most:
        raise ValueError(f"at most {most} rows, not {limit}")
    if label is not None:
        log = log.where(F.col("label") == label) if label in ("suspicious", "malicious") else log.limit(0)
    return log.orderBy(F.desc("created_at"), tie).limit(limit)


def cache_stats(entries: DataFrame, now: Column) -> DataFrame:
    """Live and expired entries per namespace at ``now``."""
    left = ttl_remaining(F.col("expires_at"), now)
    return entries.groupBy("ns").agg(
        F.count_if(F.col("expires_at") > now).alias("live"),
        F.count_if(F.col("expires_at") <= now).alias("expired"),
        F.max(left).alias("longest_ttl"))


def expire_cache(entries: DataFrame, now: Column) -> DataFrame:
    return entries.where(F.col("expires_at") > now)


_SCOPES = {"results": ["result"], "network": ["whois", "dns"], "all": None}


def flush_cache(entries: DataFrame, scope: str, domain: str | None = None) -> DataFrame:
    """Entries left after flushing: results, network, all, or one domain."""
    if scope == "domain":
        return entries.where(F.col("domain") != (domain or "").lower())
    if scope not in _SCOPES:
        raise ValueError(f"unknown cache scope: {scope}")
    gone = _SCOPES[scope]
    return entries.where(F.lit(False)) if gone is None else entries.where(~F.col("ns").isin(*gone))


def feedback_summary(feedback: DataFrame, rollup: bool = False) -> DataFrame:
    """Counts by system label and user verdict, with the share of false alarms."""
    keys = ["system_label", "user_verdict"]
    if not rollup:
        return feedback.groupBy(*keys).agg(F.count("*").alias("n"))
    wrong = F.count_if(F.col("user_verdict") == "false_positive")
    grouped = feedback.rollup(*keys).agg(
        F.count("*").alias("n"), wrong.alias("n_false_positive"), F.grouping_id().alias("level"))
    return grouped.withColumn("false_positive_rate", F.col("n_false_positive") / F.col("n"))


def feedback_vs_verdict(feedback: DataFrame, current: DataFrame) -> DataFrame:
    """Feedback beside the verdict now on file for the domain."""
    now = current.select(F.lower("domain").alias("_d"), F.col("label").alias("current_label"),
                         F.col("score").alias("current_score"))
    return (feedback.withColumn("_f", F.lower("domain")).join(now, F.col("_f") == F.col("_d"), "left")
            .withColumn("label_changed", F.col("current_label") != F.col("system_label"))
            .drop("_f", "_d"))


def registry_mismatch(log: DataFrame, registry: DataFrame) -> DataFrame:
    """Logged verdicts that the production model did not make."""
    live = broadcast_if_small(production_model(registry).select(F.col("version").alias("model_version")))
    return log.join(live, "model_version", "left_anti")
