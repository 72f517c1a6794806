"""Scoring and parsing expressions as temporary SQL functions.

Defined with plain SQL bodies, so a query that calls them is planned exactly
like one that spells the expression out.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from wardlight.functions.hosts import IP_LIKE, SCHEME

_DEFINITIONS = {
    "authority_of(raw STRING) RETURNS STRING": (
        "substring_index(substring_index(substring_index(substring_index("
        "regexp_replace(lower(btrim(coalesce(raw, ''))), r'{scheme}', ''),"
        " '/', 1), '?', 1), '#', 1), '@', -1)"),
    "host_of(raw STRING) RETURNS STRING": (
        "btrim(IF(startswith(authority_of(raw), '['), authority_of(raw),"
        " substring_index(authority_of(raw), ':', 1)), '.')"),
    "curated_key(domain STRING) RETURNS STRING": r"regexp_replace(lower(domain), r'^www\.', '')",
    "domain_entropy(name STRING) RETURNS DOUBLE": (
        "abs(aggregate(transform(array_distinct(filter(split(name, ''), c -> c <> '')),"
        " c -> (length(name) - length(replace(name, c, ''))) / length(name)),"
        " 0.0D, (acc, p) -> acc - p * log2(p)))"),
    "looks_like_ip(host STRING) RETURNS BOOLEAN": "host rlike r'{ip}'",
    "risk_label(score DOUBLE) RETURNS STRING": (
        "CASE WHEN score >= 0.8 THEN 'malicious' WHEN score >= 0.5 THEN 'suspicious' ELSE 'safe' END"),
    "risk_tier(score DOUBLE) RETURNS STRING": (
        "CASE WHEN score >= 0.8 THEN 'alert' WHEN score >= 0.5 THEN 'caution' ELSE 'silent' END"),
    "risk_confidence(score DOUBLE) RETURNS STRING": (
        "CASE WHEN greatest(score, 1 - score) >= 0.8 THEN 'high'"
        " WHEN greatest(score, 1 - score) >= 0.65 THEN 'medium' ELSE 'low' END"),
    "verdict_ttl(label STRING) RETURNS INT": "CASE WHEN label = 'safe' THEN 3600 ELSE 900 END",
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create the functions in this session; returns their names."""
    for head, body in _DEFINITIONS.items():
        body = body.replace("{scheme}", SCHEME).replace("{ip}", IP_LIKE)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in _DEFINITIONS]
