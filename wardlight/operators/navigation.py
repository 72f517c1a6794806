"""Browser navigation: pairing commits with completions, route changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.functions.hosts import url_host
from wardlight.operators.bounds import computed_once, next_value, previous_value
from wardlight.operators.lookups import latest_before


def main_frame(events: DataFrame) -> DataFrame:
    """Main-frame events with ``host`` (empty when not analysable)."""
    return computed_once(events.where(F.col("frame_id") == 0), {"host": url_host(F.col("url"))})


def navigation_pairs(events: DataFrame) -> DataFrame:
    """Completions paired with the tab's current navigation.

    The current one is the newest commit or host-changing route change; the
    completion counts if it has the same URL and an analysable host.  Anything
    older in the tab is superseded.
    """
    rows = main_frame(events)
    columns = ["tab_id", "ts", "event_id", "url", "host"]
    commits = rows.where(F.col("kind") == "commit").select(*columns)
    routes = host_changes(events).where(F.col("kind") == "history").select(*columns)
    current = commits.unionByName(routes).select(
        "tab_id", F.col("ts").alias("set_ts"), F.col("event_id").alias("commit_id"), "url", "host")
    done = rows.where(F.col("kind") == "complete").select("tab_id", "ts", "event_id", "url")
    found = latest_before(done, current, "tab_id", "ts", "set_ts", "commit_id", ["commit_id", "url", "host"])
    return found.where((F.col("found.url") == F.col("url")) & (F.col("found.host") != "")).select(
        "tab_id", F.col("found.commit_id").alias("commit_id"), F.col("event_id").alias("complete_id"),
        F.col("found.host").alias("host"))


def superseded_commits(events: DataFrame) -> DataFrame:
    """Commits that another commit of the tab replaced before they completed."""
    commits = main_frame(events).where(F.col("kind") == "commit").select("event_id", "tab_id", "ts", "host")
    followed = next_value(commits, "tab_id", "ts", "event_id", "event_id", "next_id")
    paired = navigation_pairs(events).select(F.col("commit_id").alias("event_id")).distinct()
    return followed.where(F.col("next_id").isNotNull()).join(paired, "event_id", "left_anti").select(
        "event_id", "tab_id", "next_id")


def host_changes(events: DataFrame) -> DataFrame:
    """Navigations to analyse: every commit with a host, and in-page route
    changes whose host differs from the tab's current one."""
    rows = main_frame(events).where(
        (F.col("kind") == "commit") | ((F.col("kind") == "history") & (F.col("host") != "")))
    seen = previous_value(rows, "tab_id", "ts", "event_id", "host", "previous_host")
    fresh = (F.col("kind") == "commit") | ~F.coalesce(F.col("previous_host") == F.col("host"), F.lit(False))
    return seen.where((F.col("host") != "") & fresh)
