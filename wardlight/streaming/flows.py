"""Streaming forms of the visit, verdict and navigation operators."""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from datetime import datetime
from itertools import groupby
from operator import itemgetter
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wardlight.functions.hosts import url_host
from wardlight.functions.scores import NETWORK_TTL_SECONDS
from wardlight.operators.audit import latest_per_key, log_gate, log_rows
from wardlight.operators.bounds import computed_once
from wardlight.session import scratch_path
from wardlight.streaming.deltas import DeltaTable
from wardlight.streaming.windows import LATENESS

#: The time of a closing row, behind all others.
END = datetime(9999, 1, 1)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The RocksDB state store for the streams run inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, files: str = "*.parquet",
                max_files: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream, a bounded number per batch."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
            .option("pathGlobFilter", files).parquet(folder))


def with_ending(source: DataFrame, ts: str) -> tuple[DataFrame, Callable[[], None]]:
    """The stream and a closing row's stream beside it; the function sends that row.

    It is null but for ``ts``, which lies behind all times, so it moves the watermark past
    every row that still waits.  Operators drop it by its time, which keeps the filter
    above the watermark.
    """
    spark, path = source.sparkSession, scratch_path(source.sparkSession, "ending")
    spark.createDataFrame([], source.schema).coalesce(1).write.parquet(path)
    closing = spark.readStream.schema(source.schema).parquet(path)

    def finish() -> None:
        row = tuple(END if f.name == ts else None for f in source.schema)
        spark.createDataFrame([row], source.schema).coalesce(1).write.mode("append").parquet(path)

    return source.unionByName(closing), finish


def run_to_table(df: DataFrame, name: str, *endings: Callable[[], None]) -> DataFrame:
    """Runs an append-mode stream over all available input into Parquet files
    below the shared folder and returns them as a batch frame.

    With ``endings`` (see ``with_ending``) the query goes on from its checkpoint once more,
    over the closing rows only, and what still waits comes out.
    """
    spark = df.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")

    def run() -> None:
        (df.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append")
         .trigger(availableNow=True).start(out).awaitTermination())

    run()
    for finish in endings:
        finish()
    if endings:
        run()
    return spark.read.schema(df.schema).parquet(out)


def run_updates(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Runs an aggregate in update mode; the last update of every key wins.

    A batch is written below its own id, so a repeated batch replaces itself.
    """
    spark = df.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    (df.writeStream.foreachBatch(write).option("checkpointLocation", state).outputMode("update")
     .trigger(availableNow=True).start().awaitTermination())
    return latest_per_key(spark.read.parquet(out), keys, ["batch"]).drop("batch")


def stream_hosts(events: DataFrame) -> DataFrame:
    """Main-frame commits reduced to the host worth analysing."""
    rows = events.where((F.col("frame_id") == 0) & (F.col("kind") == "commit"))
    return computed_once(rows, {"host": url_host(F.col("url"))}).where(F.col("host") != "").drop("url")


def stream_upsert(verdicts: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Flagged verdicts as an upserted table: one current row per domain.

    A batch adds its own newest rows to a ``DeltaTable`` under its batch id, so repeating
    it after a failure changes nothing, and merges are by level: no batch rewrites the
    table and no read opens more than a few folders a level.
    """
    spark = verdicts.sparkSession
    table = DeltaTable(spark, scratch_path(spark, name), ["domain"], order)

    def write(batch: DataFrame, batch_id: int) -> None:
        table.add(batch, batch_id)

    (log_rows(log_gate(verdicts)).writeStream.foreachBatch(write).option("checkpointLocation", scratch_path(spark, f"{name}-state"))
     .trigger(availableNow=True).start().awaitTermination())
    return table.read()


def _fields(text: str) -> T.StructType:
    """A struct of plain fields, made without a session: workers build it too."""
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (f.split() for f in text.split(", "))])


class InOrder(StatefulProcessor):
    """Rows of one key in time order, each once the watermark has passed it.

    ``t`` (microseconds) is the rows' first field and they are taken in the order of all
    their fields, so what comes out follows from the rows alone, not from how files fall
    into batches.  They wait in sorted runs of at most ``RUN_ROWS``, one state entry each,
    under one timer a key: its earliest row's slot of ten minutes.  A firing timer takes all
    slots that the watermark has passed and reads only the runs that begin before it, so the
    calls to the state grow with keys and runs, not with slots.  Subclasses give the
    fields, the state that a key keeps between rows, ``step`` and ``until``.
    """

    SLOT_MS = 600_000
    #: Rows of one state entry, and rows that are sorted at once when they come in.
    RUN_ROWS, SORTED_ROWS = 1000, 20_000
    fields: str
    kept: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", _fields("first long, last long, run string"), _fields("rows string"))
        self.state = handle.getValueState("state", _fields(self.kept))

    def step(self, state: tuple | None, rows: list[tuple]) -> tuple[tuple | None, list[tuple]]:
        """(new state, output rows) for the rows of one slot."""
        raise NotImplementedError

    def until(self, state: tuple) -> int | None:
        """Microsecond from which the state means nothing."""
        raise NotImplementedError

    def output(self, key: Any, found: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def _slot_end(self, t: int) -> int:
        return (t // (self.SLOT_MS * 1000) + 1) * self.SLOT_MS

    def _wait(self, rows: list[tuple]) -> int:
        """Puts rows into the state and returns the earliest time."""
        rows = _sorted(rows)
        for i in range(0, len(rows), self.RUN_ROWS):
            run = rows[i:i + self.RUN_ROWS]
            self.waiting.updateValue((run[0][0], run[-1][0], uuid.uuid4().hex), (json.dumps(run),))
        return rows[0][0]

    def _due(self, runs: list[tuple], edge: int) -> Iterator[list[tuple]]:
        """The rows before ``edge`` in order, as lists that share no slot; the runs' other rows go on waiting."""
        slot_us, pool, kept = self.SLOT_MS * 1000, [], 0
        for run, after in zip(runs, [*(r[0] for r in runs[1:]), None]):
            pool += map(tuple, json.loads(self.waiting.getValue(run)[0]))
            self.waiting.removeKey(run)
            if after is not None and len(pool) < 2 * kept + self.RUN_ROWS:
                continue
            pool = _sorted(pool)
            cut = bisect_left(pool, edge if after is None else after // slot_us * slot_us, key=itemgetter(0))
            if cut:
                yield pool[:cut]
            pool = pool[cut:]
            kept = len(pool)
        if pool:
            self.later.append(self._wait(pool))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        schema = _fields(self.fields)
        whole = {f.name for f in schema if f.dataType != T.StringType()}
        firsts, more = [], []
        for pdf in rows:
            # a column of whole numbers and nulls comes as floats
            columns = ([None if v is None or v != v else int(v) for v in pdf[n].tolist()] if n in whole else pdf[n].tolist() for n in schema.names)
            more += zip(*columns)
            if len(more) >= self.SORTED_ROWS:
                firsts.append(self._wait(more))
                more = []
        if more:
            firsts.append(self._wait(more))
        self.handle.registerTimer(self._slot_end(min(firsts)))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        slot_us = self.SLOT_MS * 1000
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() // self.SLOT_MS * self.SLOT_MS)
        edge = now * 1000
        runs = sorted(self.waiting.keys())
        due = [r for r in runs if r[0] < edge]
        self.later = [r[0] for r in runs[len(due):]]
        state = before = self.state.get()
        state = None if state is None else tuple(state)
        for rows in self._due(due, edge):
            found = []
            for slot, part in groupby(rows, lambda r: r[0] // slot_us):
                if state is not None and self._over(state, slot * slot_us):
                    state = None
                state, more = self.step(state, list(part))
                found += more
            if found:
                yield self.output(key, found)
        if state is not None and self._over(state, edge):
            state = None
        if state is not None:
            if due:
                self.state.update(state)
            until = self.until(state)
            if until is not None:
                self.handle.registerTimer(-(-until // slot_us) * self.SLOT_MS)
        elif before is not None:
            self.state.clear()
        if self.later:
            self.handle.registerTimer(self._slot_end(min(self.later)))

    def _over(self, state: tuple, at: int) -> bool:
        until = self.until(state)
        return until is not None and until <= at

    def close(self) -> None:
        pass


def _sorted(rows: list[tuple]) -> list[tuple]:
    """Rows in the order of all their fields, nulls first."""
    try:
        return sorted(rows)
    except TypeError:  # a null beside a value
        return sorted(rows, key=lambda row: [(v is not None, v) if v is not None else (False,) for v in row])


def _in_order(rows: DataFrame, ts: str, processor: InOrder, out: str) -> DataFrame:
    """``rows`` (key, the processor's fields, ``ts`` with a watermark) through the processor."""
    return rows.where(F.col(ts) < F.lit(END)).groupBy("key").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime")


class _Lookups(InOrder):
    fields, kept = "t long, event_id long, ttl long", "until long"

    def step(self, state, rows):
        until, found = state[0] if state else None, []
        for t, i, ttl in rows:
            if until is None or t >= until:
                found.append((i,))
                until = t + ttl
        return (until,) if until is not None else None, found

    def until(self, state):
        return state[0]

    def output(self, key, found):
        return pd.DataFrame({"key": [key[0]] * len(found), "event_id": [f[0] for f in found]})


def collapse_lookups(lookups: DataFrame, window_seconds: Column, delay: str = LATENESS, key: str = "domain",
                     ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The lookups that are really made: (key, event_id).

    A lookup answers its key for ``window_seconds``; later ones inside that time are
    dropped and don't prolong it.  Rows are taken by (time, id) once the watermark has
    passed them.  State holds the rows younger than ``delay`` and one time a key; timers
    remove both.  Needs the RocksDB state store.
    """
    slim = lookups.withWatermark(ts, delay).select(
        F.col(key).alias("key"), F.col(tie).cast("long").alias("event_id"), ts, F.unix_micros(ts).alias("t"),
        (window_seconds.cast("long") * 1_000_000).alias("ttl"))
    kept = _in_order(slim, ts, _Lookups(), f"key {lookups.schema[key].dataType.simpleString()}, event_id long")
    return kept.withColumnRenamed("key", key)


class _Navigation(InOrder):
    #: ``late`` puts a tab's completions behind what else happens at their time.
    fields = "t long, late int, event_id long, kind string, url string, host string"
    kept = "commit_id long, url string, host string, seen string, t long"

    def __init__(self, idle_us: int | None) -> None:
        self.idle_us = idle_us

    def step(self, state, rows):
        commit, url, host, seen, last = state or (None, None, None, None, 0)
        found = []
        for t, _, i, kind, to, at in rows:
            last = t
            if kind == "complete":
                if commit is not None and to == url and host:
                    found.append((commit, i, host))
            elif kind == "commit" or at and kind == "history":
                if kind == "commit" or at != seen:
                    commit, url, host = i, to, at
                seen = at
        return None if commit is None and seen is None else (commit, url, host, seen, last), found

    def until(self, state):
        return None if self.idle_us is None else state[4] + self.idle_us

    def output(self, key, found):
        return pd.DataFrame({"tab_id": [key[0]] * len(found), "commit_id": [f[0] for f in found],
                             "complete_id": [f[1] for f in found], "host": [f[2] for f in found]})


def navigation_stream(events: DataFrame, delay: str = LATENESS, idle_seconds: int | None = None, ts: str = "ts") -> DataFrame:
    """(tab_id, commit_id, complete_id, host): completions of the tab's current navigation.

    A state machine a tab, with the rule of ``navigation_pairs``: a commit, or a route
    change to another host, replaces the current navigation, and a completion counts if
    it has its URL.  State is one navigation a tab and the events younger than ``delay``;
    with ``idle_seconds`` a tab silent for that long is forgotten.
    """
    # a closing row has no frame; the condition hangs on the time, so that it stays above the watermark
    main = F.when(F.col(ts) < F.lit(END), F.col("frame_id")) == 0
    rows = computed_once(events.withWatermark(ts, delay).where(main), {"host": url_host(F.col("url"))})
    slim = rows.select(F.col("tab_id").alias("key"), ts, F.unix_micros(ts).alias("t"), (F.col("kind") == "complete").cast("int").alias("late"),
                       "event_id", "kind", "url", F.coalesce("host", F.lit("")).alias("host"))
    idle = None if idle_seconds is None else idle_seconds * 1_000_000
    return _in_order(slim, ts, _Navigation(idle), "tab_id long, commit_id long, complete_id long, host string")


class _Fresh(InOrder):
    #: ``asks`` is 0 for an observation, so that one counts for a visit of its own time.
    fields, kept = "t long, asks int, event_id long", "seen long"

    def __init__(self, age_us: int) -> None:
        self.age_us = age_us

    def step(self, state, rows):
        seen, found = state[0] if state else None, []
        for t, asks, i in rows:
            if not asks:
                seen = t
            else:
                found.append((i, seen is not None and t - seen < self.age_us))
        return (seen,) if seen is not None else None, found

    def until(self, state):
        return state[0] + self.age_us

    def output(self, key, found):
        return pd.DataFrame({"key": [key[0]] * len(found), "event_id": [f[0] for f in found], "fresh": [f[1] for f in found]})


def fresh_lookup(visits: DataFrame, observations: DataFrame, max_age_seconds: int = NETWORK_TTL_SECONDS, delay: str = LATENESS,
                 key: str = "domain", ts: str = "ts", tie: str = "event_id", obs_key: str = "host",
                 obs_ts: str = "observed_at") -> DataFrame:
    """(key, event_id, fresh) of each visit: is its key's newest observation at or before it younger than the limit?

    Both sides are streams, merged by key and taken in time order behind the slower
    side's watermark; a key keeps its newest observation until it is too old for any
    visit to come.  The rule of ``latest_snapshot``.
    """
    asked = visits.withWatermark(ts, delay).select(
        F.col(key).alias("key"), F.col(ts).alias("at"), F.unix_micros(ts).alias("t"), F.lit(1).alias("asks"), F.col(tie).cast("long").alias("event_id"))
    seen = observations.withWatermark(obs_ts, delay).select(
        F.col(obs_key).alias("key"), F.col(obs_ts).alias("at"), F.unix_micros(obs_ts).alias("t"), F.lit(0).alias("asks"), F.lit(0).cast("long").alias("event_id"))
    found = _in_order(asked.unionByName(seen), "at", _Fresh(max_age_seconds * 1_000_000), "key string, event_id long, fresh boolean")
    return found.withColumnRenamed("key", key)


#: How far behind the newest row a row may lie before Spark drops it; late ones above that are told apart here.
HORIZON_MS = 3650 * 86_400_000


class _Punctual(StatefulProcessor):
    """Counts a key's rows by window; rows behind the watermark come out as they are."""

    def __init__(self, delay_ms: int, width_ms: int) -> None:
        self.delay_ms, self.width_ms = delay_ms, width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", _fields("start long"), _fields("n long"))

    def _out(self, key: Any, start: list[int], n: list[int], late: list[int | None]) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]] * len(start), "start_ms": start, "n": n, "late_id": pd.array(late, "Int64")})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        on_time_from = (mark + HORIZON_MS - self.delay_ms) * 1000 if mark > 0 else None
        for pdf in rows:
            start = pdf["t"] // (self.width_ms * 1000) * self.width_ms
            late = pdf["t"] < on_time_from if on_time_from is not None else pdf["t"] != pdf["t"]
            if late.any():
                yield self._out(key, start[late].tolist(), [1] * int(late.sum()), pdf["id"][late].tolist())
            for at, n in start[~late].value_counts().items():
                known = self.counts.getValue((at,))[0] if self.counts.containsKey((at,)) else 0
                self.counts.updateValue((at,), (known + int(n),))
                self.handle.registerTimer(at + self.width_ms + self.delay_ms - HORIZON_MS)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs() + HORIZON_MS - self.delay_ms - self.width_ms
        if self.counts.containsKey((at,)):
            n = self.counts.getValue((at,))[0]
            self.counts.removeKey((at,))
            yield self._out(key, [at], [n], [None])

    def close(self) -> None:
        pass


def count_with_late(rows: DataFrame, key: str, delay_seconds: int, width_seconds: int = 3600, ts: str = "ts",
                    tie: str = "event_id") -> DataFrame:
    """Windowed counts of rows that are on time, and the late rows themselves, as one stream.

    (key, start_ms, n, late_id): a row a closed window with ``late_id`` null, and a row a
    late row with its id.  A row is late if it lies more than ``delay_seconds`` before the
    newest row of the batches before its own, Spark's own rule, but it isn't dropped: the
    watermark given to Spark lies ``HORIZON_MS`` back, the operator adds the difference.
    Needs the RocksDB state store.
    """
    slim = rows.withWatermark(ts, f"{HORIZON_MS} milliseconds").select(
        F.col(key).alias("key"), ts, F.unix_micros(ts).alias("t"), F.col(tie).cast("long").alias("id"))
    found = slim.where(F.col(ts) < F.lit(END)).groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Punctual(delay_seconds * 1000, width_seconds * 1000),
        outputStructType=f"key {rows.schema[key].dataType.simpleString()}, start_ms long, n long, late_id long",
        outputMode="Append", timeMode="EventTime")
    return found.withColumnRenamed("key", key)


def run_portions(portions: Iterable[DataFrame], ts: str, operate: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """An append-mode stream that is fed one portion after the other, each a batch of its own, then ended."""
    path, source, finish, out, state = None, None, None, None, None

    def run() -> None:
        (operate(source).writeStream.format("parquet").option("checkpointLocation", state).outputMode("append")
         .trigger(availableNow=True).start(out).awaitTermination())

    for rows in portions:
        spark = rows.sparkSession
        if path is None:
            path, out, state = (scratch_path(spark, f"{name}{part}") for part in ("-input", "", "-state"))
        rows.write.mode("append").parquet(path)
        if source is None:
            source, finish = with_ending(read_stream(spark, path, rows.schema, max_files=1_000_000), ts)
        run()
    finish()
    run()
    return spark.read.schema(operate(source).schema).parquet(out)


def dropped_as_late(query: Any) -> int:
    """Rows a finished query's stateful operators dropped behind the watermark."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
