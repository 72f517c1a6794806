"""Streaming queries: the same adapters applied to table streams, checked
against the SQL of their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.functions.scores import ttl_for_label
from wardlight.plans import visiting as V
from wardlight.plans.auditing import _CURRENT
from wardlight.plans.registry import query, with_inputs
from wardlight.operators.audit import log_gate, log_rows
from wardlight.session import ensure_utc, scratch_path
from wardlight.sources.adapters import SPARK_SQL, adapted, table
from wardlight.streaming import flows as S
from wardlight.streaming import windows as W
from wardlight.streaming.deltas import DeltaTable


def events_stream(spark, sf):
    return S.read_stream(ensure_utc(spark), sf, table(spark, sf, "events").schema, "events.parquet")


def streamed(spark, sf, name: str, source=None):
    """An adapter over the events table read as a stream."""
    text = SPARK_SQL[name].replace("FROM events", "FROM {events}")
    return spark.sql(text, events=events_stream(spark, sf) if source is None else source)


def with_ending(spark, sf, name: str):
    """The same with a closing row, and what sends it."""
    source, finish = S.with_ending(events_stream(spark, sf), "ts")
    return streamed(spark, sf, name, source), finish


@query("st1_stream_hosts", with_inputs("nav", "SELECT event_id, tab_id, host FROM n WHERE kind = 'commit' AND host <> ''", n=V._NAV))
def stream_hosts(spark, sf):
    return S.run_to_table(S.stream_hosts(streamed(spark, sf, "nav")).select("event_id", "tab_id", "host"), "hosts")


@query("st2_collapse_inflight", V.MADE)
def collapse_inflight(spark, sf):
    visits, finish = with_ending(spark, sf, "visits")
    with S.rocksdb(spark):
        return S.run_to_table(S.collapse_lookups(visits, ttl_for_label(F.col("label")), "1 hour"), "inflight", finish)


@query("st5_rate_limit_stream", with_inputs("api_calls", V.RATES))
def rate_limit_stream(spark, sf):
    counts = W.rate_limit_report(streamed(spark, sf, "api_calls"))
    return V.minute_us(S.run_updates(counts, ["endpoint", "api_key", "minute"], "rates"))


@query("st6_label_counts_stream", with_inputs("analyses", V.SLIDING))
def label_counts_stream(spark, sf):
    counts = W.label_counts(streamed(spark, sf, "analyses"), "1 hour", "15 minutes")
    return V.start_us(S.run_updates(counts, ["started_at", "label"], "labels"))


@query("st7_stream_upsert", with_inputs("analyses", "SELECT domain, event_id, label FROM cur", cur=_CURRENT.replace("FROM analyses", "FROM (SELECT * FROM analyses WHERE score >= 0.5)")))
def stream_upsert(spark, sf):
    return S.stream_upsert(streamed(spark, sf, "analyses"), "upsert", ["created_at", "event_id"]).select(
        "domain", "event_id", "label")


@query("st7_compacted_upsert", with_inputs("analyses", "SELECT domain, event_id, label FROM cur", cur=_CURRENT.replace("FROM analyses", "FROM (SELECT * FROM analyses WHERE score >= 0.5)")))
def compacted_upsert(spark, sf):
    """The same log in ten batches, the last one twice, merged by level."""
    log = log_rows(log_gate(adapted(spark, sf, "analyses")))
    table_ = DeltaTable(spark, scratch_path(spark, "deltas"), ["domain"], ["created_at", "event_id"])
    for number in [*range(10), 9]:
        table_.add(log.where(F.pmod("event_id", F.lit(10)) == number), number)
    return table_.read().select("domain", "event_id", "label")


#: Portions of the late-rows stream and the seconds a row may be late; both are in its SQL.
PORTIONS, LATE_SECONDS = 4, 864_000


@query("st9_late_rows", with_inputs("analyses", f"""SELECT start_us, label, count(*) FILTER (NOT late) AS on_time, count(*) FILTER (late) AS late FROM
  (SELECT label, epoch_us(created_at) // 3600000000 * 3600000000 AS start_us, coalesce(epoch_us(created_at) < (newest // 1000 - {LATE_SECONDS * 1000}) * 1000, false) AS late
   FROM analyses a LEFT JOIN (SELECT p.part, max(epoch_us(b.created_at)) AS newest FROM (SELECT DISTINCT event_id % {PORTIONS} AS part FROM analyses) p
     JOIN analyses b ON b.event_id % {PORTIONS} < p.part GROUP BY 1) n ON n.part = a.event_id % {PORTIONS}) GROUP BY 1, 2"""))
def late_rows(spark, sf):
    """Hourly counts of a stream that comes shuffled, in portions that each span all times: on time and late."""
    rows = adapted(spark, sf, "analyses").select("event_id", "label", "created_at")
    portions = (rows.where(F.pmod("event_id", F.lit(PORTIONS)) == p) for p in range(PORTIONS))
    with S.rocksdb(spark):
        found = S.run_portions(portions, "created_at", lambda d: S.count_with_late(d, "label", LATE_SECONDS, ts="created_at"), "late")
    late = F.col("late_id").isNotNull()
    return found.groupBy((F.col("start_ms") * 1000).alias("start_us"), "label").agg(
        F.sum(F.when(late, 0).otherwise(F.col("n"))).alias("on_time"), F.count_if(late).alias("late"))


@query("st8_navigation_stream", V.PAIRS)
def navigation_stream(spark, sf):
    nav, finish = with_ending(spark, sf, "nav")
    with S.rocksdb(spark):
        return S.run_to_table(S.navigation_stream(nav), "nav", finish)


@query("st10_fresh_lookup_stream", with_inputs("visits dns_obs", """SELECT event_id, coalesce(ts - observed_at < INTERVAL 24 HOUR, false) AS fresh
  FROM visits v ASOF LEFT JOIN (SELECT DISTINCT host, observed_at FROM dns_obs) o ON o.host = v.domain AND v.ts >= o.observed_at"""))
def fresh_lookup_stream(spark, sf):
    """Visits against the observations of the same stream's hosts, each as of its own time."""
    visits, ended = with_ending(spark, sf, "visits")
    seen, over = with_ending(spark, sf, "dns_obs")
    with S.rocksdb(spark):
        return S.run_to_table(S.fresh_lookup(visits, seen).select("event_id", "fresh"), "fresh", ended, over)
