"""Column order, defaults and StructTypes shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# The feature contract. Order and spelling are part of it.
STRUCTURAL_FEATURES = [
    "domain_length", "sld_length", "tld", "tld_is_suspicious", "num_dots",
    "num_hyphens", "num_digits", "digit_ratio", "entropy", "vowel_ratio",
    "consonant_ratio", "longest_consonant_run", "num_unique_chars",
    "char_repeat_ratio", "has_ip_in_name", "is_punycode", "num_subdomains",
    "has_www", "sld_is_numeric", "contains_phishing_keyword",
    "num_phishing_keywords", "contains_brand_name", "brand_in_subdomain",
    "typosquat_distance", "is_typosquat_candidate", "hex_ratio",
    "num_special_chars", "subdomain_entropy", "tld_length",
    "ratio_digits_to_letters",
]
NETWORK_FEATURES = [
    "domain_age_days", "is_newly_registered", "days_until_expiry",
    "registration_length_days", "registrar_is_common", "whois_country",
    "whois_privacy_enabled", "has_a_record", "num_a_records", "has_mx_record",
    "has_ns_record", "num_ns_records", "has_txt_record", "dns_ttl",
    "is_fast_flux", "has_ipv6", "dns_resolves", "network_features_available",
]
CATEGORICAL_FEATURES = ["tld", "whois_country"]
# What a network feature reads when nothing was observed.
NETWORK_DEFAULTS = {
    "domain_age_days": -1, "is_newly_registered": 0, "days_until_expiry": -1,
    "registration_length_days": -1, "registrar_is_common": 0,
    "whois_country": "unknown", "whois_privacy_enabled": 0, "has_a_record": 0,
    "num_a_records": 0, "has_mx_record": 0, "has_ns_record": 0,
    "num_ns_records": 0, "has_txt_record": 0, "dns_ttl": -1, "is_fast_flux": 0,
    "has_ipv6": 0, "dns_resolves": 0, "network_features_available": 0,
}
UNKNOWN = "unknown"

FEATURE_NAMES = STRUCTURAL_FEATURES + NETWORK_FEATURES
CONTINUOUS_FEATURES = [f for f in FEATURE_NAMES if f not in CATEGORICAL_FEATURES]
DNS_FEATURES = NETWORK_FEATURES[7:17]
WHOIS_FEATURES = NETWORK_FEATURES[:7]

REAL_FEATURES = {"digit_ratio", "entropy", "vowel_ratio", "consonant_ratio",
                 "char_repeat_ratio", "hex_ratio", "subdomain_entropy",
                 "ratio_digits_to_letters"}

LABELS = ["safe", "suspicious", "malicious"]
FEEDBACK_VERDICTS = ["false_positive", "confirmed_malicious", "unsure"]
KNOWN_VERDICTS = ["safe", "malicious", "phishing"]


def _feature_type(name: str) -> T.DataType:
    if name in CATEGORICAL_FEATURES:
        return T.StringType()
    return T.DoubleType() if name in REAL_FEATURES else T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


FEATURE_MATRIX = T.StructType(
    [T.StructField("domain", T.StringType())]
    + [T.StructField(n, _feature_type(n)) for n in FEATURE_NAMES]
    + [T.StructField("label", T.IntegerType())]
)
DNS_OBS = _struct(host=T.StringType(), rtype=T.StringType(), rdata=T.StringType(),
                  ttl=T.IntegerType(), observed_at=T.TimestampType())
WHOIS_OBS = _struct(
    registrable=T.StringType(), creation=T.ArrayType(T.TimestampType()),
    expiration=T.ArrayType(T.TimestampType()), registrar=T.StringType(),
    country=T.StringType(), text=T.StringType(), org=T.StringType(),
    name=T.StringType(), emails=T.ArrayType(T.StringType()),
    observed_at=T.TimestampType(), registrant=T.StringType())
