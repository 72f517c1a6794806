"""Lookup lists as dimension DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight import lexicon

_LISTS = {
    "suspicious_tlds": lexicon.SUSPICIOUS_TLDS,
    "phishing_keywords": lexicon.PHISHING_KEYWORDS,
    "brands": lexicon.TOP_BRANDS,
    "suffixes": lexicon.TWO_PART_SUFFIXES,
    "registrars": lexicon.COMMON_REGISTRARS,
    "privacy_keywords": lexicon.PRIVACY_KEYWORDS,
}


def load_dim(spark: SparkSession, name: str) -> DataFrame:
    """One built-in list as a single-column frame (``name``)."""
    return spark.createDataFrame([(w,) for w in _LISTS[name]], "name string")


def load_popular(spark: SparkSession, path: str, top: int | None = None) -> DataFrame:
    """Popular second-level names from a ranked ``rank,domain`` CSV."""
    ranked = (spark.read.schema("rank long, domain string").csv(path)
              .where(F.col("domain").isNotNull()))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return _names(ranked, "domain")


def popular_from_visits(visits: DataFrame, domain_col: str = "domain", min_visits: int = 100) -> DataFrame:
    """Names visited at least ``min_visits`` times, as the popular list."""
    from wardlight.operators.parse import normalize_hosts, split_domain

    counted = visits.groupBy(F.col(domain_col).alias("_d")).agg(F.count("*").alias("_n"))
    parts = split_domain(normalize_hosts(counted, "_d", "_h"), "_h")
    return (parts.where(F.col("sld") != "").groupBy(F.col("sld").alias("name"))
            .agg(F.sum("_n").alias("visits")).where(F.col("visits") >= min_visits))


def _names(df: DataFrame, col: str) -> DataFrame:
    from wardlight.operators.parse import normalize_hosts, split_domain

    parts = split_domain(normalize_hosts(df, col, "_h"), "_h")
    return parts.where(F.col("sld") != "").select(F.col("sld").alias("name")).distinct()
