"""Feature assembly: lexical plus network features in contract order."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions.hosts import normalize_host, registrable
from wardlight.operators.lexical import structural_features
from wardlight.operators.network import apply_network_defaults, network_features
from wardlight.schemas import CATEGORICAL_FEATURES, FEATURE_NAMES, UNKNOWN

Features = Callable[[DataFrame], DataFrame]


def assemble(hosts: DataFrame, dns_obs: DataFrame | None = None, whois_obs: DataFrame | None = None,
             as_of: Column | None = None, include_network: bool = True, col: str = "domain",
             popular=None, structural_fn: Features | None = None,
             network_fn: Features | None = None, tie: str | None = None, extra: Sequence[str] = (),
             asked_only: bool = False) -> DataFrame:
    """Input columns plus the 48 features, one row per input row.

    ``structural_fn`` / ``network_fn`` replace the built-in extractors; each
    maps a DataFrame to one with its feature columns added.  Either observation
    table may be missing; with one, ``as_of`` is needed.  ``extra`` names columns of the
    extractors to keep, such as the context that reason texts quote.  ``asked_only`` suits
    few hosts against many observations (see ``network_features``).
    """
    if (dns_obs is not None or whois_obs is not None) and include_network and as_of is None and network_fn is None:
        raise ValueError("observations need as_of")
    wide = structural_fn(hosts) if structural_fn else structural_features(hosts, col, popular)
    if include_network and network_fn:
        wide = apply_network_defaults(network_fn(wide))
    elif include_network and (dns_obs is not None or whois_obs is not None):
        prefix = F.expr("substring(host, 1, length(host) - length(tld) - 1)")
        sld = F.when(F.col("tld") == "", F.col("host")).otherwise(F.substring_index(prefix, ".", -1))
        keyed = wide.withColumn("_reg", registrable(F.col("host"), sld, F.col("tld")))
        wide = network_features(keyed, dns_obs, whois_obs, as_of, "host", "_reg", tie, asked_only).drop("_reg")
    else:
        wide = apply_network_defaults(wide)
    return wide.select(*hosts.columns, *FEATURE_NAMES, *extra)


def assemble_batch(hosts: DataFrame, on_error: str = "raise", col: str = "domain", **options) -> DataFrame:
    """``assemble`` with a rule for unusable names: fail, drop or zero rows."""
    if on_error not in ("raise", "skip", "zero"):
        raise ValueError(f"on_error must be raise, skip or zero, not {on_error}")
    empty = normalize_host(F.col(col)) == ""
    if on_error == "skip":
        return assemble(hosts.where(~empty), col=col, **options)
    if on_error == "raise":
        alarm = F.raise_error(F.lit("domain is empty after normalisation")).cast("string")
        return assemble(hosts.withColumn(col, F.when(empty, alarm).otherwise(F.col(col))), col=col, **options)
    wide = assemble(hosts.withColumn("_empty", empty), col=col, **options)
    zero = {c: F.when(F.col("_empty"), F.lit("0" if c in CATEGORICAL_FEATURES else 0)).otherwise(F.col(c))
            for c in FEATURE_NAMES}
    return wide.withColumns(zero).drop("_empty")


def build_feature_matrix(labeled: DataFrame, limit: int | None = None, order_col: str = "row_id",
                         store: DataFrame | None = None, **options) -> DataFrame:
    """(domain, 48 features, label): each distinct domain is extracted once.

    ``store`` holds features computed earlier (domain + 48 columns, one row a domain); only
    the domains it lacks are computed.  Stored and fresh rows are joined with the labels
    apart, so that a store bucketed by domain isn't shuffled.
    """
    work = labeled if limit is None else labeled.orderBy(order_col).limit(limit)
    domains = work.select("domain").distinct()
    if store is None:
        return label_join(assemble(domains, **options), work)
    have = store.select("domain", *FEATURE_NAMES)
    fresh = assemble(pending(domains, have), **options)
    return label_join(have, work).unionByName(label_join(fresh, work))


def pending(domains: DataFrame, store: DataFrame) -> DataFrame:
    """Domains that have no stored features yet."""
    return domains.join(store.select("domain"), "domain", "left_anti")


def label_join(features: DataFrame, labeled: DataFrame) -> DataFrame:
    """Matrix in fixed column order with nulls filled by type."""
    joined = features.join(labeled.select("domain", "label"), "domain")
    fixed = [F.coalesce(F.col(c), F.lit(UNKNOWN)).alias(c) if c in CATEGORICAL_FEATURES
             else F.coalesce(F.col(c), F.lit(0)).alias(c) for c in FEATURE_NAMES]
    return joined.select("domain", *fixed, F.col("label").cast("int").alias("label"))


def features_array(df: DataFrame, out: str = "features") -> DataFrame:
    """The 48 numeric columns as one array in contract order."""
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in FEATURE_NAMES]))


def vector_to_long(df: DataFrame, keys: list[str], columns: list[str] = FEATURE_NAMES) -> DataFrame:
    """One row per (key, feature, value)."""
    numeric = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return numeric.unpivot(keys, columns, "feature", "value")


def matrix_metadata(df: DataFrame) -> DataFrame:
    """One row describing a feature matrix."""
    rate = F.round(F.avg(F.coalesce(F.col("network_features_available").cast("double"), F.lit(0.0))), 4)
    return df.agg(
        F.count("*").alias("n_rows"), F.lit(len(FEATURE_NAMES)).alias("n_features"),
        F.lit(",".join(FEATURE_NAMES)).alias("feature_names"),
        F.lit(",".join(CATEGORICAL_FEATURES)).alias("categorical_features"),
        F.coalesce(rate, F.lit(0.0)).alias("network_features_available_rate"),
        F.count_if(F.col("label") == 0).alias("benign"), F.count_if(F.col("label") == 1).alias("malicious"))
