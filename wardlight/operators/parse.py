"""Host extraction, splitting and request validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions import hosts as H
from wardlight.functions.text import strip
from wardlight.operators.bounds import broadcast_if_small, computed_once
from wardlight.schemas import FEEDBACK_VERDICTS, KNOWN_VERDICTS, LABELS

MAX_DOMAINS_PER_REQUEST = 50
MAX_COMMENT_LENGTH = 1000


def hosts_from_urls(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds ``host`` and keeps only analysable http(s) URLs."""
    return computed_once(df, {"host": H.url_host(F.col(url_col))}).where(F.col("host") != "")


def normalize_hosts(df: DataFrame, col: str, out: str = "host") -> DataFrame:
    return computed_once(df, {out: H.normalize_host(F.col(col))})


def split_domain(df: DataFrame, host_col: str = "host",
                 suffixes: DataFrame | None = None) -> DataFrame:
    """Adds ``subdomain``, ``sld``, ``tld``.

    ``suffixes`` (column ``suffix``, two labels each) replaces the built-in
    two-part suffix list.
    """
    host = F.col(host_col)
    if suffixes is None:
        return computed_once(df, H.default_parts(host))
    table = suffixes.select(F.lower("suffix").alias("_suffix")).distinct()
    joined = df.withColumn("_last2", H.last_two_labels(host)).join(
        broadcast_if_small(table), F.col("_last2") == F.col("_suffix"), "left")
    return computed_once(joined, H.split_parts(host, F.col("_suffix").isNotNull())).drop("_last2", "_suffix")


def with_registrable(df: DataFrame, host_col: str = "host") -> DataFrame:
    """Adds ``registrable`` to a frame that already has sld and tld."""
    return df.withColumn("registrable", H.registrable(F.col(host_col), F.col("sld"), F.col("tld")))


def with_match_key(df: DataFrame, col: str = "domain") -> DataFrame:
    return df.withColumn("match_key", H.match_key(F.col(col)))


def validate_domains(df: DataFrame, col: str = "domain") -> DataFrame:
    """Adds ``clean`` (null when rejected) and ``error_code`` (null when fine)."""
    staged = computed_once(df, {"_clean": H.requested_domain(F.col(col))})
    staged = computed_once(staged, {"error_code": H.domain_error(F.col(col), F.col("_clean"))})
    return staged.withColumn("clean", F.when(F.col("error_code").isNull(), F.col("_clean"))).drop("_clean")


def split_quarantine(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rows, rejected rows) of ``validate_domains`` output."""
    bad = F.col("error_code").isNotNull()
    return validated.where(~bad).drop("error_code"), validated.where(bad).drop("clean")


def dedupe_requests(df: DataFrame, request_col: str = "request_id", pos_col: str = "pos",
                    col: str = "domain") -> DataFrame:
    """Distinct clean domains per bulk request at their first position.

    ``oversized`` marks requests that listed more entries than allowed and
    ``rejected`` those with any unusable entry; such requests fail whole.
    """
    checked = validate_domains(df, col)
    first = (checked.groupBy(request_col, "clean")
             .agg(F.min(pos_col).alias("first_pos"), F.count("*").alias("_n"),
                  F.count("error_code").alias("_bad")))
    totals = first.groupBy(request_col).agg(F.sum("_n").alias("_n"), F.sum("_bad").alias("_bad"))
    return first.where(F.col("clean").isNotNull()).drop("_n", "_bad").join(totals, request_col).select(
        request_col, "clean", "first_pos",
        (F.col("_n") > MAX_DOMAINS_PER_REQUEST).alias("oversized"),
        (F.col("_bad") > 0).alias("rejected"))


def validate_feedback(df: DataFrame) -> DataFrame:
    """Cleans the comment and adds ``error_code`` for unusable feedback."""
    comment = F.nullif(strip(F.col("user_comment")), F.lit(""))
    checked = validate_domains(df.withColumn("user_comment", comment), "domain").withColumnRenamed(
        "error_code", "_domain_error")
    code = (F.when(F.col("_domain_error").isNotNull(), "bad_domain")
            .when(~F.coalesce(F.col("system_label").isin(*LABELS), F.lit(False)), "bad_label")
            .when(~F.coalesce(F.col("user_verdict").isin(*FEEDBACK_VERDICTS), F.lit(False)), "bad_verdict")
            .when(F.length("user_comment") > MAX_COMMENT_LENGTH, "comment_too_long"))
    return checked.withColumn("error_code", code).drop("_domain_error")


def known_verdict_ok(col: Column) -> Column:
    return F.coalesce(col.isin(*KNOWN_VERDICTS), F.lit(False))


def validate_known(df: DataFrame) -> DataFrame:
    """Curated-list rows with an allowed verdict, domain lower-cased."""
    return df.where(known_verdict_ok(F.col("verdict"))).withColumn("domain", F.lower("domain"))
