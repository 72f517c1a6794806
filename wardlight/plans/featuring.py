"""Queries over network features, assembly and encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.lexicon import COMMON_REGISTRARS, PRIVACY_KEYWORDS
from wardlight.operators import assemble as A
from wardlight.operators import encode as E
from wardlight.operators import network as N
from wardlight.plans import ducktext as D
from wardlight.plans.parsing import CLEANED, PREPARED, cleaned, rounded
from wardlight.plans.registry import query, with_inputs
from wardlight.schemas import (
    CATEGORICAL_FEATURES, CONTINUOUS_FEATURES, FEATURE_NAMES, NETWORK_DEFAULTS, NETWORK_FEATURES, STRUCTURAL_FEATURES)
from wardlight.session import scratch_path
from wardlight.sources.adapters import adapted
from wardlight.sources.store import FeatureStore

AS_OF = "2024-01-20 12:00:00"
REPORT_COLUMNS = ["tld", "domain_length", "entropy", "typosquat_distance", *NETWORK_FEATURES]


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def whois_obs(spark, sf) -> DataFrame:
    return adapted(spark, sf, "whois_obs").withColumns({
        "creation": F.array_compact(F.array("creation")), "expiration": F.array_compact(F.array("expiration")),
        "emails": F.array("email")})


DNS = f"""SELECT host, (a > 0)::INT AS has_a_record, a::INT AS num_a_records, (mx > 0)::INT AS has_mx_record,
  (ns > 0)::INT AS has_ns_record, ns::INT AS num_ns_records, (txt > 0)::INT AS has_txt_record, ttl::INT AS dns_ttl,
  (ttl BETWEEN 0 AND 299 AND a > 3)::INT AS is_fast_flux, (aaaa > 0)::INT AS has_ipv6, 1 AS dns_resolves FROM
  (SELECT host, count_if(rtype = 'A') AS a, count_if(rtype = 'AAAA') AS aaaa, count_if(rtype = 'MX') AS mx,
     count_if(rtype = 'NS') AS ns, count_if(rtype = 'TXT') AS txt, coalesce(min(ttl) FILTER (rtype = 'A'), -1) AS ttl
   FROM (SELECT DISTINCT ON (host, rtype, rdata) host, rtype, rdata, ttl FROM
      (SELECT *, dense_rank() OVER (PARTITION BY host ORDER BY observed_at DESC) AS look FROM dns_obs
       WHERE observed_at > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND observed_at <= TIMESTAMP '{AS_OF}')
      WHERE look = 1 ORDER BY host, rtype, rdata, ttl) GROUP BY host)"""


def _days(a: str, b: str) -> str:
    return f"floor((epoch_us({a}) - epoch_us({b})) / 86400000000.0)::INT"


def _any(x: str, items) -> str:
    return f"(len(list_filter({D.words(items)}, lambda w: contains({x}, w))) > 0)::INT"


_T = f"TIMESTAMP '{AS_OF}'"
WHOIS = f"""SELECT obs_id, registrable, CASE WHEN age >= 0 THEN age ELSE -1 END AS domain_age_days,
  coalesce((age BETWEEN 0 AND 29)::INT, 0) AS is_newly_registered, coalesce(lft, -1) AS days_until_expiry,
  CASE WHEN len >= 0 THEN len ELSE -1 END AS registration_length_days,
  coalesce({_any('lower(registrar)', COMMON_REGISTRARS)}, 0) AS registrar_is_common,
  coalesce(nullif(lower(trim(country)), ''), 'unknown') AS whois_country,
  {_any("lower(concat_ws(' ', text, registrar, registrant, org, name, email))", PRIVACY_KEYWORDS)} AS whois_privacy_enabled
  FROM (SELECT *, {_days(_T, 'creation')} AS age, {_days('expiration', _T)} AS lft, {_days('expiration', 'creation')} AS len FROM latest)"""
LATEST = f"SELECT * FROM whois_obs WHERE observed_at <= {_T} QUALIFY row_number() OVER (PARTITION BY registrable ORDER BY observed_at DESC, obs_id DESC) = 1"
DEFAULTED = ", ".join(
    f"coalesce({c}, {repr(v)}) AS {c}" for c, v in NETWORK_DEFAULTS.items() if c != "network_features_available")
AVAILABLE = ("(dns_resolves = 1 OR domain_age_days <> -1 OR whois_country <> 'unknown')::INT AS network_features_available")


def _net_sql(hosts: str, keep: str) -> str:
    return (f"SELECT *, {AVAILABLE} FROM (SELECT {keep}, {DEFAULTED} FROM {hosts} h LEFT JOIN dns d ON d.host = h.host"
            f" LEFT JOIN whois w ON w.registrable = regexp_extract(h.host, '([^.]+\\.[^.]+)$', 1))")


@query("nf1_dns_features", with_inputs("dns_obs", DNS))
def dns_features(spark, sf):
    return N.dns_features(adapted(spark, sf, "dns_obs"), as_of())


@query("nf4_whois_features", with_inputs("whois_obs", "SELECT * EXCLUDE (obs_id) FROM whois", latest=LATEST, whois=WHOIS))
def whois_features(spark, sf):
    return N.whois_features(N.latest_whois(whois_obs(spark, sf), as_of(), "obs_id"), as_of())


@query("nf4_whois_features_all_records", with_inputs("whois_obs", "SELECT * EXCLUDE (obs_id) FROM whois",
                                                     latest="SELECT * FROM whois_obs", whois=WHOIS))
def whois_features_all(spark, sf):
    return N.whois_features(whois_obs(spark, sf), as_of())


def assembled(spark, sf, name: str = "asset_hosts", per_task: int | None = None, **options) -> DataFrame:
    """The assembled hosts; with ``per_task``, more hosts than that are dealt over tasks first, however few files hold them."""
    hosts = adapted(spark, sf, name)
    tasks = 1 if per_task is None else -(-hosts.count() // per_task)
    return A.assemble(hosts.repartition(tasks) if tasks > 1 else hosts, adapted(spark, sf, "dns_obs"), whois_obs(spark, sf),
                      as_of(), tie="obs_id", **options)


_ASSET = f"SELECT row_id, label, domain, {D.host('domain')} AS host FROM asset_hosts"
_ASSET_CTES = dict(dns=DNS, latest=LATEST, whois=WHOIS, hosts=_ASSET, parted=D.parts("hosts"),
                   lex=D.structural("parted", "row_id, label, domain, host"))
_INPUTS = "asset_hosts dns_obs whois_obs"
_FULL = f"SELECT row_id, domain, label, {', '.join(FEATURE_NAMES)} FROM (SELECT * FROM net)"
_NET = _net_sql("lex", "h.*")


@query("nf9_network_features", with_inputs(_INPUTS, f"SELECT row_id, {', '.join(NETWORK_FEATURES)} FROM net", **_ASSET_CTES, net=_NET))
def network_features(spark, sf):
    return assembled(spark, sf).select("row_id", *NETWORK_FEATURES)


@query("asm1_assemble", with_inputs(_INPUTS, f"SELECT row_id, {', '.join(FEATURE_NAMES)} FROM net", **_ASSET_CTES, net=_NET))
def assemble(spark, sf):
    return rounded(assembled(spark, sf)).select("row_id", *FEATURE_NAMES)


@query("asm1_assemble_without_network", with_inputs("asset_hosts", f"""SELECT row_id, {', '.join(STRUCTURAL_FEATURES)},
  {', '.join(f'{v!r} AS {c}' for c, v in NETWORK_DEFAULTS.items())} FROM lex""",
    hosts=_ASSET, parted=D.parts("hosts"), lex=D.structural("parted", "row_id")))
def assemble_lexical(spark, sf):
    return rounded(assembled(spark, sf, include_network=False)).select("row_id", *FEATURE_NAMES)


@query("nf10_availability_report", with_inputs(_INPUTS, """SELECT count(*) AS n_rows, round(avg(network_features_available), 9) AS available_rate,
  avg(network_features_available) < 0.5 AS too_low FROM net""", **_ASSET_CTES, net=_NET))
def availability(spark, sf):
    return rounded(N.availability_report(assembled(spark, sf)), ["available_rate"])


_RAW = f"SELECT row_id, domain, {D.host('domain')} AS host FROM raw_hosts"


@query("asm2_assemble_batch_skip", with_inputs("raw_hosts", "SELECT row_id, domain_length, tld FROM lex WHERE host <> ''",
       hosts=_RAW, parted=D.parts("hosts"), lex=D.structural("parted", "row_id, host")))
def assemble_skip(spark, sf):
    return A.assemble_batch(adapted(spark, sf, "raw_hosts"), "skip").select("row_id", "domain_length", "tld")


@query("asm2_assemble_batch_zero", with_inputs("raw_hosts", """SELECT row_id, domain_length,
  CASE WHEN host = '' THEN '0' ELSE tld END AS tld, CASE WHEN host = '' THEN 0 ELSE typosquat_distance END AS typosquat_distance FROM lex""",
       hosts=_RAW, parted=D.parts("hosts"), lex=D.structural("parted", "row_id, host")))
def assemble_zero(spark, sf):
    return A.assemble_batch(adapted(spark, sf, "raw_hosts"), "zero").select(
        "row_id", "domain_length", "tld", "typosquat_distance")


_MATRIX = dict(prepared=PREPARED, cleaned=CLEANED,
               hosts=f"SELECT domain, {D.host('domain')} AS host FROM (SELECT DISTINCT domain FROM cleaned)",
               parted=D.parts("hosts"), lex=D.structural("parted", "domain"))


@query("asm3_build_feature_matrix", with_inputs("labeled", f"""SELECT c.domain, {', '.join(f'lex.{c}' for c in STRUCTURAL_FEATURES)},
  {', '.join(f'{v!r} AS {c}' for c, v in NETWORK_DEFAULTS.items())}, c.label FROM cleaned c JOIN lex ON c.domain = lex.domain""", **_MATRIX))
def feature_matrix(spark, sf):
    return rounded(A.build_feature_matrix(cleaned(spark, sf), include_network=False))


@query("asm3_matrix_head", with_inputs("labeled", """SELECT c.domain, domain_length, c.label FROM
  (SELECT * FROM cleaned ORDER BY row_id LIMIT 100) c JOIN lex ON c.domain = lex.domain""", **_MATRIX))
def matrix_head(spark, sf):
    """The documented head-of-file build used for a smoke run."""
    return A.build_feature_matrix(cleaned(spark, sf), limit=100, include_network=False).select(
        "domain", "domain_length", "label")


@query("asm4_incremental_matrix", with_inputs("labeled", """SELECT c.domain, CASE WHEN length(c.domain) % 2 = 0 THEN 1000 ELSE lex.num_dots END::INT AS num_dots,
  c.label FROM cleaned c JOIN lex ON c.domain = lex.domain""", **_MATRIX))
def incremental_matrix(spark, sf):
    """Half of the domains come from a bucketed store (recognisable by num_dots), added in two steps."""
    rows = cleaned(spark, sf)
    old = rows.select("domain").distinct().where(F.length("domain") % 2 == 0)
    path = scratch_path(spark, "features")
    store = FeatureStore(spark, f"features_{path.rsplit('-', 1)[1]}", path, 8)
    for part in (0, 1):
        store.add(A.assemble(old.where(F.pmod(F.length("domain"), F.lit(4)) == 2 * part), include_network=False).withColumn(
            "num_dots", F.lit(1000)))
    return A.build_feature_matrix(rows, store=store.read(), include_network=False).select("domain", "num_dots", "label")


@query("set2_pending_domains", with_inputs("labeled", "SELECT DISTINCT domain FROM cleaned WHERE length(domain) % 2 = 1",
                                           prepared=PREPARED, cleaned=CLEANED))
def pending_domains(spark, sf):
    domains = cleaned(spark, sf).select("domain").distinct()
    return A.pending(domains, domains.where(F.length("domain") % 2 == 0))


@query("asm5_vector_to_long", with_inputs(_INPUTS, f"""UNPIVOT (SELECT row_id, {', '.join(c + '::DOUBLE AS ' + c for c in CONTINUOUS_FEATURES)} FROM net)
  ON {', '.join(CONTINUOUS_FEATURES)} INTO NAME feature VALUE value""", **_ASSET_CTES, net=_NET))
def vector_to_long(spark, sf):
    return A.vector_to_long(rounded(assembled(spark, sf)), ["row_id"], CONTINUOUS_FEATURES)


@query("snk2_matrix_metadata", with_inputs(_INPUTS, f"""SELECT count(*) AS n_rows, 48 AS n_features, '{','.join(FEATURE_NAMES)}' AS feature_names,
  'tld,whois_country' AS categorical_features, round(avg(network_features_available), 4) AS network_features_available_rate,
  count_if(label = 0) AS benign, count_if(label = 1) AS malicious FROM net""", **_ASSET_CTES, net=_NET))
def matrix_metadata(spark, sf):
    return A.matrix_metadata(assembled(spark, sf))


@query("jn1_label_join", with_inputs("labeled", """SELECT c.domain, count(*) AS n, sum(label)::BIGINT AS n_malicious, any_value(lex.domain_length) AS domain_length
  FROM cleaned c JOIN lex ON c.domain = lex.domain GROUP BY c.domain""", **_MATRIX))
def label_join(spark, sf):
    matrix = A.build_feature_matrix(cleaned(spark, sf), include_network=False)
    return matrix.groupBy("domain").agg(F.count("*").alias("n"), F.sum("label").alias("n_malicious"),
                                        F.max("domain_length").alias("domain_length"))


_TOKENS = """SELECT 'tld' AS feature, tld AS token FROM lexraw UNION SELECT 'whois_country', coalesce(nullif(lower(trim(country)), ''), 'unknown') FROM lexraw"""
_VOCAB = """SELECT feature, token, row_number() OVER (PARTITION BY feature ORDER BY token = 'unknown', token) - 1 AS code
  FROM (SELECT feature, token FROM tokens UNION SELECT 'tld', 'unknown' UNION SELECT 'whois_country', 'unknown')"""
_PAIRS = dict(hosts=_RAW, parted=D.parts("hosts"),
              lexraw="""SELECT row_id, coalesce(nullif(lower(trim(tld)), ''), 'unknown') AS tld, country FROM parted
                LEFT JOIN whois_obs ON row_id = obs_id""", tokens=_TOKENS, vocab=_VOCAB)


def token_rows(spark, sf) -> DataFrame:
    from wardlight.plans.parsing import hosts_and_parts

    return hosts_and_parts(spark, sf).select("row_id", "tld").join(
        adapted(spark, sf, "whois_obs").select(F.col("obs_id").alias("row_id"), F.col("country").alias("whois_country")),
        "row_id", "left")


@query("enc1_fit_vocab", with_inputs("raw_hosts whois_obs", "SELECT * FROM vocab", **_PAIRS))
def fit_vocab(spark, sf):
    return E.fit_vocab(token_rows(spark, sf))


@query("enc2_apply_vocab", with_inputs("raw_hosts whois_obs", """SELECT row_id, coalesce(v.code, (SELECT code FROM half WHERE feature = 'tld' AND token = 'unknown')) AS tld,
  coalesce(w.code, (SELECT code FROM half WHERE feature = 'whois_country' AND token = 'unknown')) AS whois_country FROM lexraw
  LEFT JOIN half v ON v.feature = 'tld' AND v.token = tld LEFT JOIN half w ON w.feature = 'whois_country'
    AND w.token = coalesce(nullif(lower(trim(country)), ''), 'unknown')""",
    **{**_PAIRS, "tokens": _TOKENS.replace("lexraw", "(SELECT * FROM lexraw WHERE row_id % 5 = 0)"), "half": "SELECT * FROM vocab"}))
def apply_vocab(spark, sf):
    """Fitted on the training part, applied to every row (unseen tokens occur)."""
    rows = token_rows(spark, sf)
    return E.apply_vocab(rows, E.fit_vocab(rows.where(F.col("row_id") % 5 == 0)))


def _hash_sql(x: str) -> str:
    acc = "0"
    for start in (1, 9, 17, 25):
        acc = f"(({acc}) * 4294967296 + ('0x' || substr(md5({x}), {start}, 8))::BIGINT) % 100003"
    return acc


@query("enc3_hash_encode", with_inputs("raw_hosts", f"SELECT row_id, {_hash_sql('t')} AS code FROM (SELECT row_id, coalesce(nullif(tld, ''), 'unknown') AS t FROM parted)",
                                       hosts=_RAW, parted=D.parts("hosts")))
def hash_encode(spark, sf):
    rows = token_rows(spark, sf).select("row_id", F.col("tld").alias("code"))
    return E.hash_encoded(rows, ["code"])


@query("enc4_apply_mapping", with_inputs("raw_hosts", f"""SELECT row_id, CASE t WHEN 'com' THEN 3 WHEN 'xyz' THEN 7 ELSE {_hash_sql('t')} END AS code
  FROM (SELECT row_id, coalesce(nullif(tld, ''), 'unknown') AS t FROM parted)""", hosts=_RAW, parted=D.parts("hosts")))
def apply_mapping(spark, sf):
    mapping = spark.createDataFrame([("com", 3), ("xyz", 7)], "token string, code long")
    rows = token_rows(spark, sf).select("row_id", F.col("tld").alias("code_of"))
    return E.apply_mapping(rows, mapping, "code_of").withColumnRenamed("code_of", "code")


@query("enc5_merge_vocab", with_inputs("raw_hosts whois_obs", """SELECT feature, token, code, feature = 'whois_country' AS refit FROM vocab""", **_PAIRS))
def merge_vocab(spark, sf):
    """The country column was constant before, so only it is fitted again."""
    rows = token_rows(spark, sf)
    first = E.fit_vocab(rows.withColumn("whois_country", F.lit("unknown")))
    return E.merge_vocab(first, rows, CATEGORICAL_FEATURES)


_SCALE = ["value", "event_id", "constant"]


@query("scl1_fit_scaler", """SELECT round(avg(value), 6) AS value__mean, round(stddev_pop(value), 6) AS value__dev,
  avg(event_id) AS event_id__mean, round(stddev_pop(event_id), 6) AS event_id__dev, 7.0::DOUBLE AS constant__mean, 1.0::DOUBLE AS constant__dev FROM events""")
def fit_scaler(spark, sf):
    from wardlight.sources.adapters import table

    rows = table(spark, sf, "events").withColumn("constant", F.lit(7.0))
    stats = E.fit_scaler(rows, _SCALE)
    return rounded(stats, stats.columns, 6)


@query("scl1_apply_scaler", """SELECT event_id, round((value - m) / s, 6) AS value, 0.0::DOUBLE AS constant
  FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)""")
def apply_scaler(spark, sf):
    from wardlight.sources.adapters import table

    rows = table(spark, sf, "events").select("event_id", "value", F.lit(7.0).alias("constant"))
    cols = ["value", "constant"]
    return rounded(E.apply_scaler(rows, E.fit_scaler(rows, cols), cols), cols, 6)
