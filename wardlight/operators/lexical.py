"""The thirty lexical features of a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions import text as X
from wardlight.functions.hosts import IP_LIKE
from wardlight.lexicon import PHISHING_KEYWORDS, SUSPICIOUS_TLDS, TOP_BRANDS
from wardlight.operators.bounds import computed_once, literal_values
from wardlight.operators.parse import normalize_hosts, split_domain
from wardlight.operators.typosquat import (
    CANDIDATE_DISTANCE, least_distance, names_literal, nearest_name, nearest_popular)
from wardlight.schemas import STRUCTURAL_FEATURES

DIGITS = "0123456789"
VOWELS = "aeiou"
CONSONANTS = "bcdfghjklmnpqrstvwxyz"
HEX = "0123456789abcdef"
DIGIT_CLASS, LETTER_CLASS = r"\p{Nd}", r"\p{L}"
SPECIAL_CLASS = r"[^\p{L}\p{N}.\-]"


def _measures(host: Column, sub: Column, sld: Column, tld: Column, words: Column) -> dict[str, Column]:
    """First layer: everything read straight from the parts."""
    return {
        "domain_length": F.length(host),
        "sld_length": F.length(sld),
        "tld_is_suspicious": X.flag(tld.isin(*SUSPICIOUS_TLDS)),
        "num_dots": X.count_of(host, "."),
        "num_hyphens": X.count_of(host, "-"),
        "num_digits": X.count_matching(host, DIGIT_CLASS),
        "_letters": X.count_matching(host, LETTER_CLASS),
        "_vowels": X.count_of(sld, VOWELS),
        "_consonants": X.count_of(sld, CONSONANTS),
        "_hex": X.count_of(sld, HEX),
        "entropy": X.shannon_entropy(sld),
        "longest_consonant_run": X.longest_run(sld, f"[{CONSONANTS}]"),
        "num_unique_chars": F.size(X.distinct_characters(sld)),
        "has_ip_in_name": X.flag(host.rlike(IP_LIKE)),
        "is_punycode": X.flag(host.startswith("xn--") | host.contains(".xn--")),
        "num_subdomains": F.when(sub == "", 0).otherwise(X.count_of(sub, ".") + 1),
        "has_www": X.flag(host.startswith("www.")),
        "sld_is_numeric": X.flag(sld.rlike(rf"^{DIGIT_CLASS}+$")),
        "num_phishing_keywords": X.count_contained(words, PHISHING_KEYWORDS),
        "contains_brand_name": X.flag(X.contains_any(sld, TOP_BRANDS)),
        "_brand_sub": X.flag(X.contains_any(sub, TOP_BRANDS)),
        "num_special_chars": X.count_matching(host, SPECIAL_CLASS),
        "subdomain_entropy": X.shannon_entropy(F.translate(sub, ".", "")),
        "tld_length": F.length(tld),
    }


def _ratios() -> dict[str, Column]:
    """Second layer: ratios and flags over the first."""
    c = F.col
    n = F.greatest(c("sld_length"), F.lit(1))
    return {
        "digit_ratio": c("num_digits") / n,
        "vowel_ratio": c("_vowels") / n,
        "consonant_ratio": c("_consonants") / n,
        "char_repeat_ratio": (c("sld_length") - c("num_unique_chars")) / n,
        "hex_ratio": c("_hex") / n,
        "ratio_digits_to_letters": c("num_digits") / (c("_letters") + 1),
        "contains_phishing_keyword": X.flag(c("num_phishing_keywords") > 0),
        "brand_in_subdomain": c("_brand_sub") * (1 - c("contains_brand_name")),
        "is_typosquat_candidate": X.flag(c("typosquat_distance").isin(*range(1, CANDIDATE_DISTANCE + 1))),
    }


def structural_features(df: DataFrame, col: str = "domain", popular: DataFrame | list | None = None,
                        suffixes: DataFrame | None = None, context: bool = False) -> DataFrame:
    """Adds ``host`` and the thirty lexical features of ``col``.

    Without a large popular list this is a map-only plan: no shuffle.
    ``context`` also adds the columns that reason texts quote
    (``matched_keywords``, ``brand``, ``similar_domain``).
    """
    parts = split_domain(normalize_hosts(df, col), "host", suffixes)
    parts = computed_once(parts, {"_words": F.when(F.col("subdomain") == "", F.col("sld"))
                                  .otherwise(F.concat_ws(".", "subdomain", "sld"))})
    # Plain projections from here on: unused features are pruned and cheap
    # filters (suffix, length) run before the costly measures.
    wide = parts.withColumns(_measures(*[F.col(c) for c in ("host", "subdomain", "sld", "tld", "_words")]))
    wide = _with_distance(wide, popular).withColumns(_ratios())
    extra = []
    if context:
        wide = wide.withColumns({
            "matched_keywords": X.contained_words(F.col("_words"), PHISHING_KEYWORDS),
            "brand": F.coalesce(X.longest_contained(F.col("sld"), TOP_BRANDS),
                                X.longest_contained(F.col("subdomain"), TOP_BRANDS))})
        extra = ["matched_keywords", "brand", "similar_domain"]
    return wide.select(*df.columns, "host", *STRUCTURAL_FEATURES, *extra)


def _with_distance(df: DataFrame, popular: DataFrame | list | None) -> DataFrame:
    names = TOP_BRANDS if popular is None else popular
    if isinstance(names, DataFrame):
        small = literal_values(names, "name")
        if small is None:
            return nearest_popular(df, names).withColumn(
                "typosquat_distance", F.coalesce("typosquat_distance", F.lit(99)))
        names = small
    pool, sld = names_literal(names), F.col("sld")
    return df.withColumns({"typosquat_distance": least_distance(sld, pool),
                           "similar_domain": nearest_name(sld, pool)["n"]})
