"""Queries over navigation, sessions and request rates (batch)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.operators import navigation as N
from wardlight.operators import sessions as R
from wardlight.plans.parsing import _URL_HOST
from wardlight.plans.registry import query, with_inputs
from wardlight.sources.adapters import DUCK_SQL, adapted
from wardlight.streaming import windows as W

_SKIP = ("CASE WHEN h IN ('', 'localhost') THEN '' ELSE h END AS host")
_NAV = f"SELECT *, {_SKIP} FROM (SELECT *, {_URL_HOST} AS h FROM nav WHERE frame_id = 0)"
_CHANGES = """SELECT * FROM (SELECT *, lag(host) OVER (PARTITION BY tab_id ORDER BY ts, event_id) AS prev
  FROM n WHERE kind = 'commit' OR (kind = 'history' AND host <> '')) WHERE host <> '' AND (kind = 'commit' OR prev IS NULL OR prev <> host)"""
_PAIRS = """SELECT tab_id, commit_id, event_id AS complete_id, host FROM (SELECT d.tab_id, d.event_id, d.url, c.event_id AS commit_id, c.url AS curl, c.host AS host
  FROM (SELECT * FROM n WHERE kind = 'complete') d ASOF JOIN (SELECT * FROM n WHERE kind = 'commit' UNION ALL SELECT * EXCLUDE (prev) FROM ch WHERE kind = 'history') c ON d.tab_id = c.tab_id AND d.ts >= c.ts)
  WHERE url = curl AND host <> ''"""


PAIRS = with_inputs("nav", "SELECT * FROM p", n=_NAV, ch=_CHANGES, p=_PAIRS)


@query("jn9_navigation_pairs", PAIRS)
def navigation_pairs(spark, sf):
    return N.navigation_pairs(adapted(spark, sf, "nav"))


@query("wn6_superseded_commits", with_inputs("nav", """SELECT event_id, tab_id, next_id FROM
  (SELECT *, lead(event_id) OVER (PARTITION BY tab_id ORDER BY ts, event_id) AS next_id FROM n WHERE kind = 'commit')
  WHERE next_id IS NOT NULL AND event_id NOT IN (SELECT commit_id FROM p)""", n=_NAV, ch=_CHANGES, p=_PAIRS))
def superseded(spark, sf):
    return N.superseded_commits(adapted(spark, sf, "nav"))


@query("wn5_host_changes", with_inputs("nav", "SELECT event_id, tab_id, host FROM ch", n=_NAV, ch=_CHANGES))
def host_changes(spark, sf):
    return N.host_changes(adapted(spark, sf, "nav")).select("event_id", "tab_id", "host")


# The lookups that are made: per domain the first, then each first one after the last one's time is over.
MADE = f"""WITH RECURSIVE visits AS ({DUCK_SQL["visits"]}), v AS (SELECT *, epoch_us(ts) AS t, CASE WHEN label = 'safe' THEN 3600 ELSE 900 END::BIGINT * 1000000 AS ttl FROM visits),
  m AS (SELECT domain, event_id, t, ttl FROM v QUALIFY row_number() OVER (PARTITION BY domain ORDER BY t, event_id) = 1
    UNION ALL SELECT domain, event_id, t, ttl FROM (SELECT v.domain, v.event_id, v.t, v.ttl, row_number() OVER (PARTITION BY v.domain ORDER BY v.t, v.event_id) AS rn
      FROM m JOIN v ON v.domain = m.domain AND v.t >= m.t + m.ttl) WHERE rn = 1)
  SELECT domain, event_id FROM m"""


@query("st4_visit_sessions", with_inputs("visits", """SELECT domain, session::BIGINT AS session, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) AS ended_us, count(*) AS visits FROM
  (SELECT *, sum(fresh) OVER (PARTITION BY domain ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER
   (PARTITION BY domain ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM visits)) GROUP BY domain, session"""))
def visit_sessions(spark, sf):
    s = R.visit_sessions(adapted(spark, sf, "visits"))
    return s.select("domain", "session", F.unix_micros("started_at").alias("started_us"),
                    F.unix_micros("ended_at").alias("ended_us"), "visits")


RATES = """SELECT endpoint, api_key, epoch_us(time_bucket(INTERVAL 1 MINUTE, ts)) AS minute_us, count(*) AS n,
  count(*) > CASE endpoint WHEN 'analyze' THEN 60 WHEN 'bulk' THEN 10 WHEN 'feedback' THEN 20 ELSE 100 END AS over_limit
  FROM api_calls GROUP BY 1, 2, 3"""


def minute_us(df):
    return df.select("endpoint", "api_key", F.unix_micros("minute").alias("minute_us"), "n", "over_limit")


@query("st5_rate_limit_report", with_inputs("api_calls", RATES))
def rate_limits(spark, sf):
    return minute_us(W.rate_limit_report(adapted(spark, sf, "api_calls")))


TUMBLING = """SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, created_at)) AS start_us, label, count(*) AS n FROM analyses GROUP BY 1, 2"""
SLIDING = """SELECT epoch_us(s) AS start_us, label, count(*) AS n FROM (SELECT label, unnest([b, b - INTERVAL 15 MINUTE, b - INTERVAL 30 MINUTE, b - INTERVAL 45 MINUTE]) AS s
  FROM (SELECT label, time_bucket(INTERVAL 15 MINUTE, created_at) AS b FROM analyses)) GROUP BY 1, 2"""


def start_us(df):
    return df.select(F.unix_micros("started_at").alias("start_us"), "label", "n")


@query("st6_label_counts_tumbling", with_inputs("analyses", TUMBLING))
def label_counts(spark, sf):
    return start_us(W.label_counts(adapted(spark, sf, "analyses"), "1 hour"))


@query("st6_label_counts_sliding", with_inputs("analyses", SLIDING))
def label_counts_sliding(spark, sf):
    return start_us(W.label_counts(adapted(spark, sf, "analyses"), "1 hour", "15 minutes"))
