"""Order-dependent operators against plain loops, with one very hot key."""

import random
import time
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardlight.functions.scores import ttl_for_label
from wardlight.operators import navigation, sessions
from wardlight.operators.bounds import next_value, previous_value
from wardlight.operators.lookups import latest_before
from wardlight.session import scratch_path
from wardlight.streaming import flows, windows
from wardlight.streaming.deltas import DeltaTable

START = datetime(2024, 1, 1)


def visit_rows(n=4000, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = rng.random() < 0.4
        day = rng.random() * (6 if hot else 30)
        rows.append((i, "hot.com" if hot else f"d{rng.randrange(60)}.com", START + timedelta(days=day, microseconds=rng.randrange(10)),
                     rng.choice(["safe", "safe", "malicious", "suspicious"])))
    rows += [(n + i, "tie.com", START + timedelta(hours=1), "safe") for i in range(5)]
    return rows


SCHEMA = "event_id long, domain string, ts timestamp, label string"


def naive_hits(rows):
    expiry, hits = {}, {}
    for i, d, ts, label in sorted(rows, key=lambda r: (r[2], r[0])):
        hits[i] = d in expiry and ts < expiry[d]
        if not hits[i]:
            expiry[d] = ts + timedelta(seconds=3600 if label == "safe" else 900)
    return hits


def test_sessions_equal_loop(spark):
    rows = visit_rows()
    want, last = {}, {}
    for i, d, ts, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        if d not in last or ts - last[d] >= timedelta(hours=1):
            want.setdefault(d, []).append(0)
        want[d][-1] += 1
        last[d] = ts
    got = sessions.visit_sessions(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {d: [r["visits"] for r in sorted(got, key=lambda r: r["session"]) if r["domain"] == d] for d in want} == want


def test_previous_and_next_value(spark):
    rows = visit_rows(1500)
    df = spark.createDataFrame(rows, SCHEMA)
    before = {r["event_id"]: r["p"] for r in previous_value(df, "domain", "ts", "event_id", "event_id", "p").collect()}
    after = {r["event_id"]: r["n"] for r in next_value(df, "domain", "ts", "event_id", "event_id", "n", 600).collect()}
    last = {}
    for i, d, ts, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        assert before[i] == last.get(d)
        if d in last:
            assert after[last[d]] == i
        last[d] = i


def test_as_of_join_equals_loop(spark):
    left, right = visit_rows(800, 1), visit_rows(500, 2)
    a = spark.createDataFrame(left, SCHEMA)
    b = spark.createDataFrame(right, SCHEMA).select("domain", F.col("ts").alias("seen_at"), F.col("event_id").alias("obs_id"))
    for bucket in (60, 3600, 10**7):
        got = {r["event_id"]: r["found"] and r["found"]["obs_id"] for r in
               latest_before(a, b, "domain", "ts", "seen_at", "obs_id", ["obs_id"], bucket).collect()}
        for i, d, ts, _ in left:
            past = [(o[2], o[0]) for o in right if o[1] == d and o[2] <= ts]
            assert got[i] == (max(past)[1] if past else None)


def nav_rows(n=600):
    rng = random.Random(9)
    kinds = ["commit", "complete", "history"]
    return [(i, START + timedelta(seconds=rng.randrange(40000)), rng.randrange(4), rng.choice(kinds), rng.choice([0, 0, 0, 1]),
             rng.choice(["https://a.com/x", "https://b.com/y", "http://localhost/", "https://a.com/z"])) for i in range(n)]


def test_navigation_equals_event_loop(spark):
    rows = nav_rows()
    record, pairs, fresh = {}, set(), set()
    for i, ts, tab, kind, frame, url in sorted(rows, key=lambda r: (r[1], {"complete": 1}.get(r[3], 0), r[0])):
        host = None if "localhost" in url else url.split("/")[2]
        if frame:
            continue
        if kind == "commit":
            record[tab] = (i, url, host)
            if host:
                fresh.add(i)
        elif kind == "history":
            if host and (tab not in record or record[tab][2] != host):
                record[tab] = (i, url, host)
                fresh.add(i)
        elif tab in record and record[tab][1] == url and record[tab][2]:
            pairs.add((record[tab][0], i))
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, tab_id long, kind string, frame_id int, url string")
    assert {(r["commit_id"], r["complete_id"]) for r in navigation.navigation_pairs(df).collect()} == pairs
    assert {r["event_id"] for r in navigation.host_changes(df).collect()} == fresh


@pytest.fixture(scope="module")
def visit_files(spark):
    """The visits as files in time order, so streams see several batches."""
    path = scratch_path(spark, "visit-files")
    rows = sorted(visit_rows(900), key=lambda r: (r[2], r[0]))
    for i in range(0, len(rows), 200):
        spark.createDataFrame(rows[i:i + 200], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path, rows


def made_lookups(rows):
    hits = naive_hits(rows)
    return sorted(r[0] for r in rows if not hits[r[0]])


def ended(spark, path, max_files=1000, ts="ts"):
    return flows.with_ending(flows.read_stream(spark, path, spark.read.parquet(path).schema, max_files=max_files), ts)


def in_files(spark, rows, schema, size):
    path = scratch_path(spark, "files")
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i:i + size], schema).coalesce(1).write.mode("append").parquet(path)
    return path


class StateInMemory:
    """What a processor asks of its handle, with the number of calls; map, value and timers of one key."""

    def __init__(self):
        self.map, self.value, self.timers, self.calls = {}, None, set(), 0

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        return type("Value", (), {"get": self.getOne, "update": self.setOne, "clear": lambda _: self.setOne(None), "exists": lambda _: self.getOne(None) is not None})()

    def counted(self, result=None):
        self.calls += 1
        return result

    def getOne(self, _=None):
        return self.counted(self.value)

    def setOne(self, *value):
        self.value = self.counted(value[-1])

    def updateValue(self, key, value):
        self.map[key] = self.counted(value)

    def getValue(self, key):
        return self.counted(self.map[key])

    def containsKey(self, key):
        return self.counted(key in self.map)

    def removeKey(self, key):
        self.counted(self.map.pop(key))

    def keys(self):
        return iter(self.counted(list(self.map)))

    def registerTimer(self, at):
        self.counted(self.timers.add(at))


def fire(processor, handle, watermark_ms):
    """All timers up to the watermark, as Spark fires them."""
    values = type("Values", (), {"getCurrentWatermarkInMs": lambda _: watermark_ms})()
    out = []
    while handle.timers and min(handle.timers) <= watermark_ms:
        at = min(handle.timers)
        info = type("Info", (), {"getExpiryTimeInMs": lambda _: at})()
        out += [tuple(r) for pdf in processor.handleExpiredTimer(("k",), values, info) for r in pdf.itertuples(index=False)]
        handle.timers.discard(at)
    return out


def test_state_calls_do_not_grow_with_slots():
    # 300 visits and 300 observations of one key, each in a slot of its own, come at once and are due in two steps
    rng = random.Random(3)
    day, slot = 24 * 3600 * 10**6, 600 * 10**6
    places = rng.sample(range(4000), 600)
    rows = [(p * slot + 5, int(i % 2), i if i % 2 else 0) for i, p in enumerate(places)]
    processor, handle = flows._Fresh(day), StateInMemory()
    processor.init(handle)
    list(processor.handleInputRows(("k",), iter([pd.DataFrame(rows[:400], columns=["t", "asks", "event_id"]), pd.DataFrame(rows[400:], columns=["t", "asks", "event_id"])]), None))
    early = fire(processor, handle, 2000 * 600_000)
    got = early + fire(processor, handle, 10**13)
    seen = [t for t, asks, _ in rows if not asks]
    want = {i: any(0 <= t - s < day for s in seen) for t, asks, i in rows if asks}
    assert {i: f for _, i, f in got} == want and len(got) == len(want)
    assert len(early) == sum(asks for t, asks, _ in rows if t < 2000 * slot)
    assert not handle.map and handle.value is None and handle.calls < 60


@pytest.mark.parametrize("max_files", [1, 100])
def test_streamed_lookups_equal_loop(spark, visit_files, max_files):
    path, rows = visit_files
    stream, finish = ended(spark, path, max_files)
    with flows.rocksdb(spark):
        got = flows.run_to_table(flows.collapse_lookups(stream, ttl_for_label(F.col("label")), "2 hours"), "t", finish).collect()
    assert sorted(r["event_id"] for r in got) == made_lookups(rows)


def test_streamed_lookups_of_one_key_in_random_order(spark):
    rng = random.Random(4)
    rows = [(i, "hot.com", START + timedelta(seconds=rng.randrange(20 * 86400)), rng.choice(["safe", "malicious"])) for i in range(12_000)]
    stream, finish = ended(spark, in_files(spark, rows, SCHEMA, len(rows)))
    with flows.rocksdb(spark):
        got = flows.run_to_table(flows.collapse_lookups(stream, ttl_for_label(F.col("label")), "1 minute"), "h", finish).collect()
    assert sorted(r["event_id"] for r in got) == made_lookups(rows)


@pytest.mark.parametrize("max_files", [1, 100])
def test_streamed_navigation_equals_batch(spark, max_files):
    rows = sorted(nav_rows(1500), key=lambda r: (r[1] + timedelta(minutes=r[0] % 9), r[0]))  # up to nine minutes out of order
    path = in_files(spark, rows, "event_id long, ts timestamp, tab_id long, kind string, frame_id int, url string", 200)
    stream, finish = ended(spark, path, max_files)
    with flows.rocksdb(spark):
        got = flows.run_to_table(flows.navigation_stream(stream), "n", finish).collect()
    want = navigation.navigation_pairs(spark.read.parquet(path)).collect()
    pairs = lambda rows: sorted((r["tab_id"], r["commit_id"], r["complete_id"], r["host"]) for r in rows)
    assert pairs(got) == pairs(want) and len(got) > 50


def test_streamed_navigation_forgets_idle_tabs(spark):
    at = lambda h: START + timedelta(hours=h)
    rows = [(1, at(0), 1, "commit", 0, "https://a.com/"), (2, at(5), 2, "commit", 0, "https://b.com/"), (3, at(6), 2, "complete", 0, "https://b.com/"),
            (4, at(9), 1, "complete", 0, "https://a.com/"), (5, at(9), 2, "commit", 0, "https://b.com/")]
    for idle, want in ((None, {3, 4}), (7200, {3})):
        stream, finish = ended(spark, in_files(spark, rows, "event_id long, ts timestamp, tab_id long, kind string, frame_id int, url string", 1), 1)
        with flows.rocksdb(spark):
            got = flows.run_to_table(flows.navigation_stream(stream, idle_seconds=idle), "i", finish).collect()
        assert {r["complete_id"] for r in got} == want


@pytest.mark.parametrize("max_files", [1, 100])
def test_streamed_fresh_lookups_equal_loop(spark, visit_files, max_files):
    path, rows = visit_files
    seen = sorted(((f"d{i % 60}.com" if i % 3 else "hot.com", START + timedelta(hours=i * 37 % 719)) for i in range(400)), key=lambda r: r[1])
    seen += [("tie.com", START + timedelta(hours=1))] * 2
    obs, over = ended(spark, in_files(spark, sorted(seen, key=lambda r: r[1]), "host string, observed_at timestamp", 100), max_files, "observed_at")
    visits, finish = ended(spark, path, max_files)
    with flows.rocksdb(spark):
        got = {r["event_id"]: r["fresh"] for r in flows.run_to_table(flows.fresh_lookup(visits, obs), "f", finish, over).collect()}
    day = timedelta(hours=24)
    assert got == {i: any(h == d and t <= ts and ts - t < day for h, t in seen) for i, d, ts, _ in rows}


def test_late_rows_come_out_beside_the_counts(spark):
    hour = lambda h, m=0: START + timedelta(hours=h, minutes=m)
    portions = [[(1, "a", hour(0)), (2, "a", hour(30))], [(3, "a", hour(20)), (4, "a", hour(19, 59)), (5, "b", hour(29)), (6, "a", hour(60))],
                [(7, "a", hour(50)), (8, "b", hour(1)), (9, "a", hour(50, 30))]]
    frames = [spark.createDataFrame(p, "event_id long, label string, ts timestamp") for p in portions]
    with flows.rocksdb(spark):
        got = flows.run_portions(frames, "ts", lambda d: flows.count_with_late(d, "label", 36_000), "p").collect()
    assert sorted(r["late_id"] for r in got if r["late_id"]) == [4, 8]
    base = int((START - datetime(1970, 1, 1)).total_seconds() * 1000)
    counts = {(r["label"], (r["start_ms"] - base) // 3_600_000): r["n"] for r in got if r["late_id"] is None}
    assert counts == {("a", 0): 1, ("a", 30): 1, ("a", 20): 1, ("b", 29): 1, ("a", 60): 1, ("a", 50): 2}


def test_deltas_are_merged_by_level(spark):
    rng = random.Random(8)
    rows = [(f"k{rng.randrange(40)}", i, rng.random()) for i in range(600)]
    path = scratch_path(spark, "deltas")
    table = DeltaTable(spark, path, ["key"], ["i"], fanout=3)
    for n in range(30):
        table.add(spark.createDataFrame(rows[n * 20:n * 20 + 20], "key string, i long, x double").coalesce(1), n)
        if n in (7, 29):
            table.add(spark.createDataFrame([("k1", 10_000, 0.0)], "key string, i long, x double"), n)  # repeated: ignored
    newest = {k: (k, i, x) for k, i, x in rows}
    assert sorted(map(tuple, table.read().collect())) == sorted(newest.values())
    assert len(table.segments()) <= table.most_segments(30) <= 8 and table.versions() == list(range(30))
    early = {k: (k, i, x) for k, i, x in rows[:220]}
    assert sorted(map(tuple, table.read(10).collect())) == sorted(early.values())
    before = sorted(map(tuple, table.read().collect()))
    assert table.vacuum() > 20 and sorted(map(tuple, table.read().collect())) == before and table.versions() == [28, 29]
    again = DeltaTable(spark, path, ["key"], ["i"], fanout=3)
    again.add(spark.createDataFrame([("new", 1, 0.0)], "key string, i long, x double"), 30)
    assert again.read().count() == len(before) + 1
    with pytest.raises(ValueError, match="no batch"):
        DeltaTable(spark, scratch_path(spark, "none"), ["key"], ["i"]).read()


@pytest.mark.parametrize("max_files", [1, 100])
def test_streamed_counts_equal_batch(spark, visit_files, max_files):
    path, _ = visit_files
    schema = spark.read.parquet(path).schema
    counts = lambda d: windows.label_counts(d, "1 hour", "30 minutes", ts="ts", delay="30 days")
    stream = flows.run_updates(counts(flows.read_stream(spark, path, schema, max_files=max_files)), ["started_at", "label"], "c")
    assert sorted(map(str, stream.select("started_at", "label", "n").collect())) == sorted(map(str, counts(spark.read.parquet(path)).collect()))


def test_streamed_upsert_keeps_latest(spark, visit_files):
    path, rows = visit_files
    stream = flows.read_stream(spark, path, spark.read.parquet(path).schema, max_files=1).withColumn("score", F.lit(0.9))
    got = {r["domain"]: r["event_id"] for r in flows.stream_upsert(stream, "u", ["ts", "event_id"]).collect()}
    assert got == {d: i for i, d, ts, _ in sorted(rows, key=lambda r: (r[2], r[0]))}


def test_late_rows_are_counted(spark):
    # Lateness is judged by the watermark of the batch before.
    path = scratch_path(spark, "late")
    for i, hours in enumerate([0, 30, 30, 1]):
        df = spark.createDataFrame([(i, "a.com", START + timedelta(hours=hours), "safe")], SCHEMA)
        df.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    stream = flows.read_stream(spark, path, df.schema, max_files=1)
    out, state = scratch_path(spark, "o"), scratch_path(spark, "s")
    q = (windows.label_counts(stream, ts="ts").writeStream.format("parquet").option("checkpointLocation", state)
         .trigger(availableNow=True).start(out))
    q.awaitTermination()
    assert flows.dropped_as_late(q) == 1
