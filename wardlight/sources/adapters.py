"""Projections that give the given tables the shapes the operators take.

Each adapter is one SELECT over base tables in the SQL subset Spark and DuckDB
share, so a query and its checking SQL read identical inputs.  Only timestamp
arithmetic is spelled per engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardlight.session import ensure_utc

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ensure_utc(spark).read.parquet(f"{folder}/{name}.parquet")


class SparkText:
    @staticmethod
    def plus_seconds(ts: str, seconds: str) -> str:
        return f"timestamp_micros(unix_micros(cast({ts} as timestamp)) + ({seconds}) * 1000000)"


class DuckText:
    @staticmethod
    def plus_seconds(ts: str, seconds: str) -> str:
        return f"make_timestamp(epoch_us({ts}) + ({seconds}) * 1000000)"


_TLD = ("CASE p_size % 8 WHEN 0 THEN 'com' WHEN 1 THEN 'xyz' WHEN 2 THEN 'top' WHEN 3 THEN 'co.uk'"
        " WHEN 4 THEN 'online' WHEN 5 THEN 'org' WHEN 6 THEN 'net' ELSE 'de' END")
_NAME = "replace(p_name, ' ', '-') || cast(p_partkey % 97 as string)"

# Raw inputs in every form a caller might send, derived row by row from part.
_RAW = f"""CASE p_partkey % 17
  WHEN 0 THEN 'https://www.' || {_NAME} || '.' || {_TLD} || '/login?x=1'
  WHEN 1 THEN 'HTTP://User:pw@' || upper({_NAME}) || '.' || {_TLD} || ':8080/a/b'
  WHEN 2 THEN 'secure-login.paypal.' || {_NAME} || '.' || {_TLD}
  WHEN 3 THEN 'xn--' || {_NAME} || '.' || {_TLD}
  WHEN 4 THEN '192-168-0-' || cast(p_partkey % 300 as string) || '.' || {_TLD}
  WHEN 5 THEN 'a.b.c.' || {_NAME} || '.' || {_TLD} || '.'
  WHEN 6 THEN 'paypa' || cast(p_partkey % 100 as string) || '.' || {_TLD}
  WHEN 7 THEN cast(10000 + p_partkey as string) || '.' || {_TLD}
  WHEN 8 THEN lower(replace(p_brand, '#', '')) || '.' || {_TLD}
  WHEN 9 THEN '  ' || {_NAME} || '.' || {_TLD} || '#frag '
  WHEN 10 THEN 'https://' || {_NAME} || '_x!.' || {_TLD}
  WHEN 11 THEN CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 5 = 1 THEN 'localhost'
       WHEN p_size % 5 = 2 THEN 'http://[2001:db8::1]:443/x' WHEN p_size % 5 = 3 THEN '10.0.0.' || cast(p_size as string)
       ELSE 'a..' || {_NAME} || '.com' END
  WHEN 12 THEN 'bücher-' || {_NAME} || '.' || {_TLD}
  WHEN 13 THEN 'www.google' || cast(p_partkey % 7 as string) || '.' || {_TLD}
  WHEN 14 THEN 'account-verify.' || lower(p_type) || cast(p_partkey % 500 as string) || '.' || {_TLD}
  WHEN 15 THEN 'http://a' || cast(p_partkey as string) || '.com/x@' || {_TLD}
  ELSE {_NAME} || '.' || {_TLD} END"""

_HASH = "(l_orderkey * 37 + l_partkey * 11 + l_linenumber * 101)"


def _adapters(d) -> dict[str, str]:
    return {
        "raw_hosts": f"SELECT p_partkey AS row_id, {_RAW} AS domain FROM part",
        "urls": "SELECT page_id, url FROM pages",
        "visited_urls": """SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'ftp://h' || cast(user_id as string) || '.com/'
              WHEN 1 THEN 'http://localhost:80/' WHEN 2 THEN 'https://printer.local/x'
              WHEN 3 THEN 'HTTPS://user:pw@H' || cast(user_id as string) || '.Example.COM.:443/p?q#f'
              WHEN 4 THEN 'http://127.0.0.1/a' WHEN 5 THEN 'not a url'
              ELSE 'https://www.h' || cast(user_id as string) || '.com/' || event_type END AS url FROM events""",
        "labeled": f"""SELECT p_partkey AS row_id,
              CASE WHEN p_partkey % 41 = 0 THEN '  ' ELSE upper(replace(p_name, ' ', '-')) || cast(p_size as string)
                   || '.' || {_TLD} || ' ' END AS domain,
              CASE p_partkey % 23 WHEN 0 THEN 'x' WHEN 1 THEN '2' WHEN 2 THEN '0.5' WHEN 3 THEN '-1'
                   ELSE cast(CASE WHEN p_size % 3 = 0 OR p_partkey % 29 = 0 THEN 1 ELSE 0 END as string) END AS label
              FROM part""",
        "requests": """SELECT CASE WHEN cast(floor(p_partkey / 40) as bigint) % 4 = 3
                   THEN cast(floor(p_partkey / 40) as bigint) - 1 ELSE cast(floor(p_partkey / 40) as bigint) END AS request_id,
              p_partkey AS pos, CASE WHEN p_partkey % 400 = 7 THEN 'bad_name' ELSE
              'Www.' || replace(p_name, ' ', '-') || '.com' END AS domain FROM part""",
        "feedback": """SELECT event_id, 'h' || cast(user_id as string) || CASE WHEN event_id % 50 = 0 THEN '' ELSE '.com' END AS domain,
              CASE event_id % 5 WHEN 0 THEN 'safe' WHEN 1 THEN 'suspicious' WHEN 4 THEN 'odd' ELSE 'malicious' END AS system_label,
              CASE event_type WHEN 'view' THEN 'false_positive' WHEN 'click' THEN 'confirmed_malicious'
                   WHEN 'error' THEN 'nonsense' ELSE 'unsure' END AS user_verdict,
              CASE WHEN event_id % 3 = 0 THEN '  ' ELSE ' ' || props END AS user_comment,
              cast(ts as timestamp) AS created_at FROM events""",
        "dns_obs": """SELECT 'h' || cast(user_id as string) || '.com' AS host,
              CASE event_type WHEN 'view' THEN 'A' WHEN 'click' THEN 'AAAA' WHEN 'purchase' THEN 'MX'
                   WHEN 'signup' THEN 'NS' ELSE 'TXT' END AS rtype, cast(event_id as string) AS rdata,
              cast(floor(value) as int) * 10 AS ttl, date_trunc('hour', cast(ts as timestamp)) AS observed_at FROM events""",
        "whois_obs": f"""SELECT o_orderkey AS obs_id, 'h' || cast(o_custkey as string) || '.com' AS registrable,
              CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE cast(o_orderdate as timestamp) END AS creation,
              CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE {d.plus_seconds('o_orderdate', '(o_custkey % 900 - 40) * 86400')} END AS expiration,
              CASE o_orderpriority WHEN '1-URGENT' THEN 'GoDaddy.com, LLC' WHEN '2-HIGH' THEN 'NameCheap'
                   WHEN '3-MEDIUM' THEN 'Obscure Registry' WHEN '5-LOW' THEN ' ' ELSE NULL END AS registrar,
              CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE ' ' || n_name END AS country,
              CASE WHEN o_orderkey % 3 = 0 THEN 'Registrant: REDACTED FOR PRIVACY' ELSE 'Registrant: ' || c_name END AS text,
              c_mktsegment AS org, c_name AS name,
              CASE WHEN o_orderkey % 17 = 0 THEN 'proxy@example.com' ELSE 'a@example.com' END AS email,
              CASE WHEN o_orderkey % 19 = 0 THEN 'Withheld for Privacy' ELSE c_name END AS registrant,
              cast(o_orderdate as timestamp) AS observed_at
              FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
        "asset_hosts": """SELECT c_custkey AS row_id, CASE WHEN c_custkey % 3 = 0 THEN 'www.' ELSE '' END
              || 'h' || cast(c_custkey as string) || '.com' AS domain,
              c_custkey % 2 AS label FROM customer""",
        "scored": f"""SELECT l_orderkey, l_linenumber, 'v' || l_linestatus AS model_version,
              cast(l_linenumber % 5 as int) AS fold,
              cast({_HASH} % 10001 as double) / 10000 AS score,
              CASE WHEN ({_HASH} % 10001) + (l_suppkey * 7919 % 6001) > 8000 THEN 1 ELSE 0 END AS y
              FROM lineitem""",
        "analyses": f"""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'H' ELSE 'h' END || cast(user_id as string) || '.com' AS domain,
              least(value / 100, cast(1 as double)) AS score,
              CASE WHEN value / 100 >= 0.8 THEN 'malicious' WHEN value / 100 >= 0.5 THEN 'suspicious' ELSE 'safe' END AS label,
              'v' || cast(event_id % 3 as string) AS model_version,
              CASE WHEN event_id % 4 = 0 THEN 'api' ELSE 'extension' END AS source,
              cast(ts as timestamp) AS created_at FROM events""",
        "known": """SELECT s_suppkey AS seq, 'H' || cast(s_suppkey as string) || '.com' AS domain,
              CASE s_suppkey % 4 WHEN 0 THEN 'safe' WHEN 1 THEN 'malicious' WHEN 2 THEN 'phishing' ELSE 'bogus' END AS verdict,
              CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'feed' ELSE 'curated' END AS source,
              s_suppkey % 5 <> 0 AS is_active FROM supplier""",
        "registry": """SELECT n_nationkey AS seq, 'v' || cast(n_nationkey % 6 as string) AS version,
              CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE cast(n_nationkey as double) / 32 END AS auc_roc,
              CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_name END AS notes,
              n_nationkey % 6 = 1 AS is_production FROM nation""",
        "nav": """SELECT event_id, cast(ts as timestamp) AS ts, user_id AS tab_id,
              CASE event_type WHEN 'view' THEN 'commit' WHEN 'signup' THEN 'commit' WHEN 'purchase' THEN 'history' ELSE 'complete' END AS kind,
              cast(CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END as int) AS frame_id,
              CASE WHEN event_id % 25 = 3 THEN 'http://localhost/' ELSE
              'https://s' || cast((event_id % 2) + (user_id % 3) as string) || '.com/p' END AS url FROM events""",
        "visits": """SELECT event_id, 'h' || cast(user_id % 40 as string) || '.com' AS domain, cast(ts as timestamp) AS ts,
              CASE WHEN user_id % 3 = 0 THEN 'safe' WHEN value > 60 THEN 'malicious' ELSE 'safe' END AS label FROM events""",
        "api_calls": """SELECT event_id, cast(ts as timestamp) AS ts,
              CASE event_type WHEN 'view' THEN 'analyze' WHEN 'click' THEN 'analyze' WHEN 'purchase' THEN 'bulk'
                   WHEN 'signup' THEN 'feedback' ELSE 'stats' END AS endpoint,
              'key' || cast(user_id % 2 as string) AS api_key FROM events""",
        "cache_sets": f"""SELECT o_orderkey AS seq, CASE o_orderkey % 3 WHEN 0 THEN 'result' WHEN 1 THEN 'whois' ELSE 'dns' END AS ns,
              'h' || cast(o_custkey % 100 as string) || '.com' AS domain,
              CASE WHEN o_totalprice > 300000 THEN 'malicious' ELSE 'safe' END AS label,
              {d.plus_seconds('o_orderdate', 'o_orderkey % 86400')} AS cached_at FROM orders""",
        "cache_reads": f"""SELECT l_orderkey * 10 + l_linenumber AS read_id, 'h' || cast(l_suppkey % 100 as string) || '.com' AS domain,
              {d.plus_seconds('l_shipdate', '(l_orderkey * 7 + l_partkey) % 86400')} AS ts FROM lineitem""",
        "pushes": f"""SELECT l_orderkey AS row_key,
              cast((l_partkey * 7 + l_linenumber * 5 + l_suppkey) % 48 as int) AS feature_no,
              cast(l_quantity as double) - 8 AS value,
              cast(l_partkey % 200 - 40 as double) / 64 AS contribution FROM lineitem""",
    }


SPARK_SQL = _adapters(SparkText)
DUCK_SQL = _adapters(DuckText)


def adapted(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One adapter as a DataFrame over the tables in ``folder``."""
    text = SPARK_SQL[name]
    words = set(text.replace("\n", " ").split())
    frames = {t: table(spark, folder, t) for t in TABLES if t in words}
    for t in frames:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return ensure_utc(spark).sql(text, **frames)
