"""DNS and WHOIS features from observation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions.scores import NETWORK_TTL_SECONDS, whole_days
from wardlight.functions.text import contains_any, flag, strip
from wardlight.lexicon import COMMON_REGISTRARS, PRIVACY_KEYWORDS
from wardlight.operators.bounds import broadcast_if_small
from wardlight.schemas import NETWORK_DEFAULTS, UNKNOWN

# Thresholds of the derived flags.
FAST_FLUX_TTL, FAST_FLUX_RECORDS = 300, 3
NEW_DOMAIN_DAYS = 30
WHOIS_TEXTS = ["text", "registrar", "registrant", "org", "name", "emails"]


def dns_features(dns_obs: DataFrame, as_of: Column, max_age_seconds: int = NETWORK_TTL_SECONDS) -> DataFrame:
    """One row per host from its newest snapshot in (as_of - max age, as_of].

    The records of a host with one ``observed_at`` are one snapshot.  A record seen
    several times in it counts once; earlier looks don't add up, later ones aren't
    known yet.  Old rows are cut before the first shuffle; a record is merged before
    it is moved.
    """
    def of(rtype: str) -> Column:
        return F.count_if(F.col("rtype") == rtype)

    age = F.unix_micros(as_of) - F.unix_micros("observed_at")
    recent = dns_obs.where((age >= 0) & (age < max_age_seconds * 1_000_000))
    records = recent.groupBy("host", "observed_at", "rtype", "rdata").agg(F.min("ttl").alias("ttl"))
    ttl = F.min(F.when(F.col("rtype") == "A", F.col("ttl")))
    snapshots = records.groupBy("host", "observed_at").agg(
        of("A").alias("a"), of("AAAA").alias("aaaa"), of("MX").alias("mx"), of("NS").alias("ns"),
        of("TXT").alias("txt"), F.coalesce(ttl, F.lit(-1)).cast("int").alias("dns_ttl"))
    newest = F.max_by(F.struct("a", "aaaa", "mx", "ns", "txt", "dns_ttl"), "observed_at")
    counts = snapshots.groupBy("host").agg(newest.alias("_s")).select("host", "_s.*")
    c = F.col
    low_ttl = (c("dns_ttl") >= 0) & (c("dns_ttl") < FAST_FLUX_TTL)
    return counts.select(
        "host", flag(c("a") > 0).alias("has_a_record"), c("a").cast("int").alias("num_a_records"),
        flag(c("mx") > 0).alias("has_mx_record"), flag(c("ns") > 0).alias("has_ns_record"),
        c("ns").cast("int").alias("num_ns_records"), flag(c("txt") > 0).alias("has_txt_record"),
        "dns_ttl", flag(low_ttl & (c("a") > FAST_FLUX_RECORDS)).alias("is_fast_flux"),
        flag(c("aaaa") > 0).alias("has_ipv6"),
        flag(c("a") + c("aaaa") + c("mx") + c("ns") + c("txt") > 0).alias("dns_resolves"))


def latest_whois(whois_obs: DataFrame, as_of: Column, tie: str | None = None) -> DataFrame:
    """Newest record per registrable domain at or before ``as_of`` (map-side combined)."""
    whois_obs = whois_obs.where(F.col("observed_at") <= as_of)
    rest = [c for c in whois_obs.columns if c != "registrable"]
    order = F.struct("observed_at", tie) if tie else F.col("observed_at")
    return (whois_obs.groupBy("registrable").agg(F.max_by(F.struct(*rest), order).alias("_r"))
            .select("registrable", "_r.*"))


def whois_features(whois_obs: DataFrame, as_of: Column) -> DataFrame:
    """WHOIS features per record; list-valued dates read their first entry.

    Privacy words are searched in all texts of the record that the table has.
    """
    texts = [c for c in WHOIS_TEXTS if c in whois_obs.columns]
    created, expires = F.get("creation", F.lit(0)), F.get("expiration", F.lit(0))
    staged = whois_obs.withColumns({
        "_age": whole_days(as_of, created), "_left": whole_days(expires, as_of),
        "_length": whole_days(expires, created),
        "_blob": F.lower(F.concat_ws(" ", *texts))})
    c = F.col
    country = F.lower(strip(c("country")))
    return staged.select(
        "registrable",
        F.when(c("_age") >= 0, c("_age")).otherwise(-1).alias("domain_age_days"),
        flag(c("_age").between(0, NEW_DOMAIN_DAYS - 1)).alias("is_newly_registered"),
        F.coalesce(c("_left"), F.lit(-1)).alias("days_until_expiry"),
        F.when(c("_length") >= 0, c("_length")).otherwise(-1).alias("registration_length_days"),
        flag(contains_any(F.lower("registrar"), COMMON_REGISTRARS)).alias("registrar_is_common"),
        F.when(country != "", country).otherwise(UNKNOWN).alias("whois_country"),
        flag(contains_any(c("_blob"), PRIVACY_KEYWORDS)).alias("whois_privacy_enabled"))


def apply_network_defaults(df: DataFrame) -> DataFrame:
    """Documented value for every network feature that is null or absent."""
    return df.withColumns({
        name: F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value)
        for name, value in NETWORK_DEFAULTS.items()})


def with_availability(df: DataFrame) -> DataFrame:
    seen = ((F.col("dns_resolves") == 1) | (F.col("domain_age_days") != -1)
            | (F.col("whois_country") != UNKNOWN))
    return df.withColumn("network_features_available", flag(seen))


def network_features(hosts: DataFrame, dns_obs: DataFrame | None, whois_obs: DataFrame | None, as_of: Column,
                     host_col: str = "host", registrable_col: str = "registrable",
                     tie: str | None = None, asked_only: bool = False) -> DataFrame:
    """Left-joins the feature sets that are given to ``hosts`` and fills the defaults.

    Right sides hold one row per key, so a host that many rows share
    fans out on the left only, where AQE can split it.  With ``asked_only`` observations of
    other hosts go before they are aggregated: right for a request of some hosts, a wasted
    join where most of the observed ones are asked for.
    """
    joined = hosts
    if asked_only and dns_obs is not None:
        dns_obs = _asked(dns_obs, "host", hosts, host_col)
    if asked_only and whois_obs is not None:
        whois_obs = _asked(whois_obs, "registrable", hosts, registrable_col)
    if dns_obs is not None:
        dns = dns_features(dns_obs, as_of).withColumnRenamed("host", "_dns_host")
        joined = joined.join(dns, F.col(host_col) == F.col("_dns_host"), "left").drop("_dns_host")
    if whois_obs is not None:
        whois = whois_features(latest_whois(whois_obs, as_of, tie), as_of).withColumnRenamed("registrable", "_registrable")
        joined = joined.join(whois, F.col(registrable_col) == F.col("_registrable"), "left").drop("_registrable")
    return with_availability(apply_network_defaults(joined))


def _asked(obs: DataFrame, key: str, hosts: DataFrame, col: str) -> DataFrame:
    return obs.join(broadcast_if_small(hosts.select(F.col(col).alias(key)).distinct()), key, "left_semi")


def availability_report(df: DataFrame, minimum: float = 0.5) -> DataFrame:
    """Share of rows with network data and whether it is too low to trust."""
    rate = F.avg(F.col("network_features_available").cast("double"))
    return df.agg(F.count("*").alias("n_rows"), rate.alias("available_rate"),
                  (rate < minimum).alias("too_low"))
