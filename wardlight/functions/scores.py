"""Score bands, cache lifetimes and categorical hashing as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlight.functions.text import strip
from wardlight.schemas import UNKNOWN

# Score bands, lifetimes and the hash space.
SUSPICIOUS_AT, MALICIOUS_AT = 0.50, 0.80
HIGH_CERTAINTY, MEDIUM_CERTAINTY = 0.80, 0.65
TTL_SECONDS = {"safe": 3600, "suspicious": 900, "malicious": 900}
NETWORK_TTL_SECONDS = 86400
HASH_SPACE = 100003


def clamp01(score: Column) -> Column:
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def score_to_label(score: Column) -> Column:
    return (F.when(score >= MALICIOUS_AT, "malicious")
            .when(score >= SUSPICIOUS_AT, "suspicious").otherwise("safe"))


def score_to_confidence(score: Column, scheme: str = "certainty") -> Column:
    """``certainty``: by max(s, 1-s).  ``distance``: by fixed outer bands."""
    if scheme == "certainty":
        sure = F.greatest(score, 1.0 - score)
        high, medium = sure >= HIGH_CERTAINTY, sure >= MEDIUM_CERTAINTY
    elif scheme == "distance":
        high = (score <= 0.15) | (score >= 0.85)
        medium = (score <= 0.35) | (score >= 0.65)
    else:
        raise ValueError(f"unknown confidence scheme: {scheme}")
    return F.when(high, "high").when(medium, "medium").otherwise("low")


def tier_for_score(score: Column) -> Column:
    return (F.when(score >= MALICIOUS_AT, "alert")
            .when(score >= SUSPICIOUS_AT, "caution").otherwise("silent"))


def should_notify(score: Column) -> Column:
    return score >= SUSPICIOUS_AT


def ttl_for_label(label: Column) -> Column:
    return F.when(label == "safe", TTL_SECONDS["safe"]).otherwise(TTL_SECONDS["malicious"])


def ttl_remaining(expires_at: Column, now: Column) -> Column:
    """Seconds left; -2 when the entry is absent or already gone."""
    left = F.unix_micros(expires_at) - F.unix_micros(now)
    return (F.when(expires_at.isNull() | (left <= 0), F.lit(-2))
            .otherwise(F.floor(left / 1000000)).cast("long"))


def category_token(value: Column) -> Column:
    """Trimmed lower-case token; null and blank read as ``unknown``."""
    token = F.lower(strip(F.coalesce(value.cast("string"), F.lit(UNKNOWN))))
    return F.when(token == "", UNKNOWN).otherwise(token)


def md5_mod(text: Column, modulus: int) -> Column:
    """The MD5 digest as a 128-bit number modulo ``modulus`` (below 2^31)."""
    digest = F.md5(text)
    acc = F.lit(0).cast("long")
    for start in (1, 9, 17, 25):
        word = F.conv(F.substring(digest, start, 8), 16, 10).cast("long")
        acc = (acc * F.lit(1 << 32) + word) % F.lit(modulus)
    return acc


def hash_encode(value: Column) -> Column:
    return md5_mod(category_token(value), HASH_SPACE)


def hash_fraction(seed: str, key: Column) -> Column:
    """A reproducible number in [0, 1) from a seed and a key."""
    word = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8),
                  16, 10)
    return word.cast("double") / F.lit(float(1 << 32))


def whole_days(later: Column, earlier: Column) -> Column:
    """Elapsed days rounded down, also for negative spans."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86400000000.0)).cast("int")
