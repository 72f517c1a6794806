"""Queries over host parsing, validation, cleaning and lexical features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.functions import hosts as H
from wardlight.lexicon import PHISHING_KEYWORDS, TOP_BRANDS
from wardlight.operators import clean, parse, typosquat
from wardlight.operators.lexical import structural_features
from wardlight.plans import ducktext as D
from wardlight.plans.registry import query, with_inputs
from wardlight.schemas import REAL_FEATURES, STRUCTURAL_FEATURES
from wardlight.sources.adapters import adapted, table
from wardlight.session import scratch_path
from wardlight.sources.dims import load_dim, load_popular, popular_from_visits

HOSTS = f"SELECT row_id, domain, {D.host('domain')} AS host FROM raw_hosts"
PARTED = D.parts("hosts")


def rounded(df: DataFrame, columns=REAL_FEATURES, places: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns if c in df.columns})


def hosts_and_parts(spark, sf) -> DataFrame:
    return parse.split_domain(parse.normalize_hosts(adapted(spark, sf, "raw_hosts"), "domain"))


_URL_HOST = ("regexp_replace(lower(regexp_extract(url, '^\\s*[hH][tT][tT][pP][sS]?://(?:[^/?#\\\\]*@)?"
             "(\\[[^\\]/?#\\\\]*\\]|[^/?#\\\\:]*)', 1)), '\\.$', '')")


def _url_sql(source: str, keep: str) -> str:
    return (f"SELECT * FROM (SELECT {keep}, {_URL_HOST} AS host FROM {source}) WHERE host NOT IN "
            "('', 'localhost', '::1', '[::1]') AND NOT ends_with(host, '.local') AND NOT ends_with(host, '.localhost')"
            " AND NOT starts_with(host, '127.')")


@query("src4_suspicious_tld_parts", with_inputs("raw_hosts", f"""SELECT tld, count(*) AS n FROM parted
  WHERE list_contains({D.words(['com', 'xyz', 'top', 'online'])}, tld) AND tld <> 'com' GROUP BY tld""",
    hosts=HOSTS, parted=PARTED))
def suspicious_tld_counts(spark, sf):
    dim = load_dim(spark, "suspicious_tlds")
    return (hosts_and_parts(spark, sf).join(F.broadcast(dim), F.col("tld") == F.col("name"), "left_semi")
            .groupBy("tld").agg(F.count("*").alias("n")))


@query("src5_hosts_from_pages", with_inputs("urls", _url_sql("urls", "page_id")))
def hosts_from_pages(spark, sf):
    return parse.hosts_from_urls(adapted(spark, sf, "urls")).select("page_id", "host")


@query("src5_hosts_from_visits", with_inputs("visited_urls", _url_sql("visited_urls", "event_id")))
def hosts_from_visits(spark, sf):
    return parse.hosts_from_urls(adapted(spark, sf, "visited_urls")).select("event_id", "host")


@query("nrm1_normalize_host", with_inputs("raw_hosts", "SELECT row_id, host FROM hosts", hosts=HOSTS))
def normalize_host(spark, sf):
    return parse.normalize_hosts(adapted(spark, sf, "raw_hosts"), "domain").select("row_id", "host")


@query("nrm2_split_domain", with_inputs("raw_hosts", "SELECT row_id, subdomain, sld, tld FROM parted",
                                        hosts=HOSTS, parted=PARTED))
def split_domain(spark, sf):
    return hosts_and_parts(spark, sf).select("row_id", "subdomain", "sld", "tld")


@query("nrm2_split_domain_suffix_table", with_inputs("raw_hosts", "SELECT row_id, subdomain, sld, tld FROM parted",
                                                     hosts=HOSTS, parted=PARTED))
def split_domain_table(spark, sf):
    suffixes = load_dim(spark, "suffixes").withColumnRenamed("name", "suffix")
    hosts = parse.normalize_hosts(adapted(spark, sf, "raw_hosts"), "domain")
    return parse.split_domain(hosts, "host", suffixes).select("row_id", "subdomain", "sld", "tld")


@query("nrm3_registrable_domain", with_inputs("raw_hosts", """SELECT row_id,
  CASE WHEN sld <> '' AND tld <> '' THEN sld || '.' || tld ELSE host END AS registrable FROM parted""",
                                              hosts=HOSTS, parted=PARTED))
def registrable(spark, sf):
    return parse.with_registrable(hosts_and_parts(spark, sf)).select("row_id", "registrable")


@query("nrm4_match_key", with_inputs("raw_hosts", """SELECT row_id,
  CASE WHEN starts_with(lower(domain), 'www.') THEN substr(lower(domain), 5) ELSE lower(domain) END AS match_key
  FROM raw_hosts"""))
def match_key(spark, sf):
    return parse.with_match_key(adapted(spark, sf, "raw_hosts")).select("row_id", "match_key")


def clean_sql(source: str, keep: str, col: str = "domain") -> str:
    """Validation as SQL: keep, clean and error_code."""
    label = "^[a-z0-9\\x{a1}-\\x{ffff}](?:[a-z0-9\\x{a1}-\\x{ffff}-]{0,61}[a-z0-9\\x{a1}-\\x{ffff}])?$"
    step = f"regexp_replace(lower(trim({col}, {D.WS})), '{D.SCHEME}', '')"
    step = f"split_part({step}, '@', -1)"
    for sep in "/?#:":
        step = f"split_part({step}, '{sep}', 1)"
    step = f"rtrim(trim({step}, {D.WS}), '.')"
    odd = f"list_filter(string_split(c, '.'), lambda q: q = '' OR NOT regexp_matches(q, '{label}'))[1]"
    return f"""SELECT *, CASE WHEN error_code IS NULL THEN c END AS clean FROM (SELECT *,
      CASE WHEN {col} IS NULL THEN 'not_string' WHEN trim({col}, {D.WS}) = '' THEN 'empty'
        WHEN c = '' THEN 'empty_after_normalization' WHEN length(c) > 253 THEN 'too_long'
        WHEN regexp_matches(c, '^[0-9]{{1,3}}(?:\\.[0-9]{{1,3}}){{3}}$') THEN 'ip_address'
        WHEN NOT contains(c, '.') THEN 'no_dot' WHEN {odd} = '' THEN 'empty_label' WHEN {odd} IS NOT NULL THEN 'bad_label'
        WHEN NOT regexp_matches(split_part(c, '.', -1), '^(?:xn--[a-z0-9-]+|[a-z\\x{{a1}}-\\x{{ffff}}]{{2,}})$') THEN 'bad_tld'
        END AS error_code FROM (SELECT {keep}, {step} AS c FROM {source}))"""


@query("val1_validate_domain", with_inputs("raw_hosts", "SELECT row_id, clean, error_code FROM v",
                                           v=clean_sql("raw_hosts", "row_id, domain")))
def validate_domain(spark, sf):
    return parse.validate_domains(adapted(spark, sf, "raw_hosts")).select("row_id", "clean", "error_code")


@query("val1_quarantine_counts", with_inputs("raw_hosts", """SELECT error_code, count(*) AS n FROM v
  WHERE error_code IS NOT NULL GROUP BY error_code""", v=clean_sql("raw_hosts", "row_id, domain")))
def quarantine_counts(spark, sf):
    _, bad = parse.split_quarantine(parse.validate_domains(adapted(spark, sf, "raw_hosts")))
    return bad.groupBy("error_code").agg(F.count("*").alias("n"))


@query("val2_dedupe_requests", with_inputs("requests", """SELECT v.request_id, clean, min(pos) AS first_pos,
  any_value(n > 50) AS oversized, any_value(bad > 0) AS rejected FROM v
  JOIN (SELECT request_id, count(*) AS n, count(error_code) AS bad FROM v GROUP BY request_id) t ON t.request_id = v.request_id
  WHERE clean IS NOT NULL GROUP BY v.request_id, clean""", v=clean_sql("requests", "request_id, pos, domain")))
def dedupe_requests(spark, sf):
    return parse.dedupe_requests(adapted(spark, sf, "requests"))


@query("val3_validate_feedback", with_inputs("feedback", f"""SELECT event_id, clean,
  nullif(trim(user_comment, {D.WS}), '') AS user_comment,
  CASE WHEN error_code IS NOT NULL THEN 'bad_domain' WHEN system_label NOT IN ('safe', 'suspicious', 'malicious') THEN 'bad_label'
    WHEN user_verdict NOT IN ('false_positive', 'confirmed_malicious', 'unsure') THEN 'bad_verdict'
    WHEN length(trim(user_comment, {D.WS})) > 1000 THEN 'comment_too_long' END AS error_code FROM v""",
    v=clean_sql("feedback", "event_id, domain, system_label, user_verdict, user_comment")))
def validate_feedback(spark, sf):
    return parse.validate_feedback(adapted(spark, sf, "feedback")).select(
        "event_id", "clean", "user_comment", "error_code")


@query("val4_validate_known", with_inputs("known", """SELECT lower(domain) AS domain, verdict FROM known
  WHERE verdict IN ('safe', 'malicious', 'phishing')"""))
def validate_known(spark, sf):
    return parse.validate_known(adapted(spark, sf, "known")).select("domain", "verdict")


PREPARED = f"""SELECT *, CASE WHEN domain = '' THEN 'empty_domain' WHEN number IS NULL THEN 'non_numeric_label'
  WHEN trunc(number) NOT IN (0, 1) THEN 'label_out_of_range' END AS dropped_by
  FROM (SELECT row_id, lower(trim(domain, {D.WS})) AS domain, try_cast(label AS DOUBLE) AS number FROM labeled)"""
CLEANED = "SELECT row_id, domain, trunc(number)::INT AS label FROM prepared WHERE dropped_by IS NULL"


def cleaned(spark, sf) -> DataFrame:
    return clean.clean_labeled(adapted(spark, sf, "labeled"))


@query("cln1_clean_labeled", with_inputs("labeled", CLEANED, prepared=PREPARED))
def clean_labeled(spark, sf):
    return cleaned(spark, sf)


@query("ag15_drop_report", with_inputs("labeled", """SELECT count(*) AS n_raw,
  count_if(dropped_by = 'empty_domain') AS dropped_empty_domain, count_if(dropped_by = 'non_numeric_label') AS dropped_non_numeric_label,
  count_if(dropped_by = 'label_out_of_range') AS dropped_label_out_of_range, count_if(dropped_by IS NULL) AS n_valid
  FROM prepared""", prepared=PREPARED))
def drop_report(spark, sf):
    return clean.drop_report(adapted(spark, sf, "labeled"))


@query("cln2_label_conflicts", with_inputs("labeled", """SELECT domain, count(DISTINCT label) AS n_labels FROM cleaned
  GROUP BY domain HAVING count(DISTINCT label) > 1""", prepared=PREPARED, cleaned=CLEANED))
def label_conflicts(spark, sf):
    return clean.label_conflicts(cleaned(spark, sf))


FIRST = "SELECT * FROM cleaned QUALIFY row_number() OVER (PARTITION BY domain ORDER BY row_id) = 1"


@query("cln3_dedupe_first", with_inputs("labeled", FIRST, prepared=PREPARED, cleaned=CLEANED))
def dedupe_first(spark, sf):
    return clean.dedupe_first(cleaned(spark, sf))


@query("ag1_class_balance", with_inputs("labeled", """SELECT count_if(label = 0) AS benign, count_if(label = 1) AS malicious,
  round(count_if(label = 0) / count(*), 9) AS benign_share, round(count_if(label = 1) / count(*), 9) AS malicious_share FROM firsts""",
                                        prepared=PREPARED, cleaned=CLEANED, firsts=FIRST))
def class_balance(spark, sf):
    return rounded(clean.class_balance(clean.dedupe_first(cleaned(spark, sf))), ["benign_share", "malicious_share"])


@query("cln4_coerce_numeric", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 WHEN event_id % 5 IN (1, 2) THEN 0 ELSE value END AS value,
  (value > 50)::INT::DOUBLE AS big, CASE WHEN event_id % 2 = 0 THEN value ELSE
  ((((('0x' || substr(h, 1, 8))::BIGINT % 100003 * 4294967296 + ('0x' || substr(h, 9, 8))::BIGINT) % 100003 * 4294967296
   + ('0x' || substr(h, 17, 8))::BIGINT) % 100003 * 4294967296 + ('0x' || substr(h, 25, 8))::BIGINT) % 100003)::DOUBLE END AS text_value
  FROM (SELECT *, md5(event_type) AS h FROM events)""")
def coerce_numeric(spark, sf):
    e = F.col("event_id") % 5
    raw = table(spark, sf, "events").select(
        "event_id", F.when(e == 0, F.lit(float("nan"))).when(e == 1, F.lit(float("inf")))
        .when(e == 2, F.lit(None).cast("double")).otherwise(F.col("value")).alias("value"),
        (F.col("value") > 50).alias("big"),
        F.when(F.col("event_id") % 2 == 0, F.col("value").cast("string")).otherwise(F.col("event_type")).alias("text_value"))
    return clean.coerce_numeric(raw, ["value", "big", "text_value"])


@query("cln5_check_vector", "SELECT event_id, 1 AS n_infinite FROM events WHERE event_id % 7 = 0")
def check_vector(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 7 == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan"))).alias("a"),
        F.col("value").alias("b"))
    return clean.infinite_rows(rows, ["a", "b"]).select("event_id", "n_infinite")


@query("cln5_check_vector_passes", "SELECT event_id, value FROM events")
def check_vector_passes(spark, sf):
    """Vectors without infinite values come through as they are."""
    return clean.check_vector(table(spark, sf, "events").select("event_id", "value"), ["value", "event_id"])


@query("src4_popular_file", with_inputs("visits", "SELECT DISTINCT split_part(domain, '.', 1) AS name FROM visits"))
def popular_file(spark, sf):
    """A ranked file of domains, written and read back as names."""
    path = scratch_path(spark, "popular")
    adapted(spark, sf, "visits").groupBy("domain").agg(F.count("*").alias("n")).select("n", "domain").write.csv(path)
    return load_popular(spark, path)


@query("sf_structural_features", with_inputs("raw_hosts", D.structural("parted", "row_id"), hosts=HOSTS, parted=PARTED))
def structural(spark, sf):
    feats = structural_features(adapted(spark, sf, "raw_hosts"))
    return rounded(feats).select("row_id", *STRUCTURAL_FEATURES)


_PAGE_HOSTS = f"SELECT page_id, regexp_replace(host, '\\.example\\.', '.') AS host FROM ({_url_sql('urls', 'page_id')})"


@query("sf_structural_pages", with_inputs("urls", D.structural("parted", "page_id"), hosts=_PAGE_HOSTS, parted=PARTED))
def structural_pages(spark, sf):
    hosts = parse.hosts_from_urls(adapted(spark, sf, "urls")).select(
        "page_id", F.regexp_replace("host", r"\.example\.", ".").alias("domain"))
    return rounded(structural_features(hosts)).select("page_id", *STRUCTURAL_FEATURES)


@query("sf3_suspicious_hosts_by_length", with_inputs("raw_hosts", """SELECT host, domain_length, tld, row_id FROM f
  WHERE tld_is_suspicious = 1""",
    hosts=HOSTS, parted=PARTED, f=f"SELECT host, tld, row_id, length(host)::INT AS domain_length,"
    f" list_contains({D.words(['xyz', 'top', 'online'])}, tld)::INT AS tld_is_suspicious FROM parted"))
def suspicious_by_length(spark, sf):
    """Every host under a high-abuse suffix, with its length."""
    feats = structural_features(adapted(spark, sf, "raw_hosts"))
    return feats.where(F.col("tld_is_suspicious") == 1).select("host", "domain_length", "tld", "row_id")


@query("sf13_context_columns", with_inputs("raw_hosts", f"""SELECT row_id,
  array_to_string(list_sort(list_filter({D.words(PHISHING_KEYWORDS)},
   lambda w: contains(CASE WHEN subdomain = '' THEN sld ELSE subdomain || '.' || sld END, w))), '|') AS keywords,
  coalesce(list_filter(b, lambda w: contains(sld, w))[1], list_filter(b, lambda w: contains(subdomain, w))[1]) AS brand
  FROM (SELECT *, {D.words(sorted(TOP_BRANDS, key=lambda w: (-len(w), w)))} AS b FROM parted)""", hosts=HOSTS, parted=PARTED))
def context_columns(spark, sf):
    feats = structural_features(adapted(spark, sf, "raw_hosts"), context=True)
    return feats.select("row_id", F.array_join("matched_keywords", "|").alias("keywords"), "brand")


_NEAREST = """SELECT row_id, sld, coalesce(d, 99)::INT AS typosquat_distance, name AS similar_domain FROM parted
  LEFT JOIN (SELECT s, min(levenshtein(replace(s, 'ü', '~'), name)) AS d, arg_min(name, (levenshtein(replace(s, 'ü', '~'), name), name)) AS name
     FROM (SELECT DISTINCT sld AS s FROM parted WHERE sld <> ''), names GROUP BY s) ON s = sld"""


@query("jn5_nearest_popular", with_inputs("raw_hosts", _NEAREST, hosts=HOSTS, parted=PARTED,
                                          names=f"SELECT unnest({D.words(TOP_BRANDS)}) AS name"))
def nearest_popular(spark, sf):
    return typosquat.nearest_popular(hosts_and_parts(spark, sf), load_dim(spark, "brands")).select(
        "row_id", "sld", "typosquat_distance", "similar_domain")


@query("jn5_nearest_popular_from_visits", with_inputs("raw_hosts visits", _NEAREST, hosts=HOSTS, parted=PARTED,
    names="SELECT split_part(domain, '.', 1) AS name FROM visits GROUP BY 1 HAVING count(*) >= 100"))
def nearest_popular_chunked(spark, sf):
    """Popular list derived from traffic, through the long-list path."""
    popular = popular_from_visits(adapted(spark, sf, "visits"), min_visits=100)
    return typosquat.nearest_popular(hosts_and_parts(spark, sf), popular, literal_limit=4).select(
        "row_id", "sld", "typosquat_distance", "similar_domain")


@query("sf15_popular_typosquat", with_inputs("raw_hosts visits", f"""SELECT row_id, typosquat_distance, (typosquat_distance BETWEEN 1 AND 2)::INT AS is_typosquat_candidate,
  similar_domain FROM ({_NEAREST})""", hosts=HOSTS, parted=PARTED,
    names="SELECT split_part(domain, '.', 1) AS name FROM visits GROUP BY 1 HAVING count(*) >= 100"))
def popular_typosquat(spark, sf):
    """The lexical features against a list of popular names counted from visits."""
    popular = popular_from_visits(adapted(spark, sf, "visits"), min_visits=100)
    feats = structural_features(adapted(spark, sf, "raw_hosts"), popular=popular, context=True)
    return feats.select("row_id", "typosquat_distance", "is_typosquat_candidate", "similar_domain")


@query("jn5_typosquat_candidates", with_inputs("raw_hosts", """SELECT s AS sld, name AS similar_domain, levenshtein(replace(s, 'ü', '~'), name)::INT AS distance
  FROM (SELECT DISTINCT sld AS s FROM parted), names WHERE s <> '' AND levenshtein(replace(s, 'ü', '~'), name) BETWEEN 1 AND 2""",
    hosts=HOSTS, parted=PARTED, names=f"SELECT unnest({D.words(TOP_BRANDS)}) AS name"))
def typosquat_candidates(spark, sf):
    return typosquat.typosquat_candidates(hosts_and_parts(spark, sf), load_dim(spark, "brands"))


@query("sql_functions", with_inputs("raw_hosts analyses", f"""SELECT row_id, {D.host('domain')} AS host,
  {D.entropy(D.host('domain'))} AS entropy, regexp_matches({D.host('domain')}, '{D.IP_LIKE}') AS ip_like FROM raw_hosts"""))
def sql_functions(spark, sf):
    from wardlight.functions.sqlfuncs import register_sql_functions

    register_sql_functions(spark)
    return spark.sql("""SELECT row_id, host_of(domain) AS host, round(domain_entropy(host_of(domain)), 9) AS entropy,
        looks_like_ip(host_of(domain)) AS ip_like FROM {raw}""", raw=adapted(spark, sf, "raw_hosts"))


@query("sql_functions_scores", with_inputs("analyses", """SELECT event_id, regexp_replace(lower(domain), '^www\\.', '') AS curated, label AS risk_label,
  CASE WHEN s >= 0.8 THEN 'alert' WHEN s >= 0.5 THEN 'caution' ELSE 'silent' END AS risk_tier,
  CASE WHEN greatest(s, 1 - s) >= 0.8 THEN 'high' WHEN greatest(s, 1 - s) >= 0.65 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN label = 'safe' THEN 3600 ELSE 900 END AS ttl, lower(domain) || ':80' AS authority FROM (SELECT *, score AS s FROM analyses)"""))
def sql_score_functions(spark, sf):
    """The functions over names and scores that the query above doesn't call."""
    from wardlight.functions.sqlfuncs import register_sql_functions

    register_sql_functions(spark)
    return spark.sql("""SELECT event_id, curated_key('www.' || domain) AS curated, risk_label(score) AS risk_label,
        risk_tier(score) AS risk_tier, risk_confidence(score) AS confidence, verdict_ttl(label) AS ttl,
        authority_of('http://u@' || domain || ':80/x') AS authority FROM {log}""", log=adapted(spark, sf, "analyses"))
