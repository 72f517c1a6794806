"""WARC archives of captures and their merged index."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.session import scratch_path

ARCHIVE_BYTES = 32 << 20
ROWS_PER_RANGE = 200_000
_CRLF = "\r\n"
INDEX = ("urlkey string, captured timestamp, page_id long, payload_bytes long, payload_digest string, "
         "record_type string, refers_to long, run string, place long")


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1; every 20 bits of the hexadecimal form are four digits."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, path: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """A WARC record per row of ``pages`` (page_id, url, html) under ``path``.

    Of payloads (UTF-8 of html, null: empty) that are equal and at least ``least`` bytes
    long, the one of smallest page_id is a response; the others are revisits that name
    it and carry no payload.  Payloads below ``least`` are all responses.

    Records are text rows joined by the blank lines that end a record, so Spark's own
    writer makes the files and commits each task once.  A file holds as many records as
    make ``archive_bytes`` on average.  The capture time of a page is its id in seconds.
    A null url has no target, a null id an empty record id; line ends in urls are
    escaped.  Rows that repeat an id and payload are alike: all responses or revisits.
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn(
        "digest", base32_sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html").cast("long"))
    groups = rows.groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    kept = scratch_path(spark, "payloads")
    groups.write.parquet(kept)
    groups = spark.read.parquet(kept)
    average = groups.agg(F.sum(F.col("n") * (F.col("size") + 400)) / F.sum("n")).first()[0] or 1.0
    shared = groups.where(F.col("n") > 1).where(F.col("size") >= least).select(F.col("digest").alias("same"), "first")
    # written, so that its size is known when the join is planned
    kept = scratch_path(spark, "shared")
    shared.write.parquet(kept)
    shared = spark.read.parquet(kept)
    rows = rows.join(shared, F.col("digest") == F.col("same"), "left")
    revisit = F.coalesce(F.col("first") != F.coalesce(F.col("page_id"), F.lit(-1)), F.lit(False))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))
    target = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    when = F.date_format(F.timestamp_seconds(F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(
        F.lit("WARC/1.1" + _CRLF),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))), line("WARC-Date", when),
        F.coalesce(line("WARC-Target-URI", target), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat(
            line("WARC-Refers-To", urn(F.col("first"))),
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Payload-Length", F.col("size").cast("string")))).otherwise(""),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))), F.lit(_CRLF))
    record = F.concat(head, F.when(revisit, "").otherwise(F.col("html")))
    (rows.select(record.alias("record")).write.option("lineSep", _CRLF * 2)
     .option("maxRecordsPerFile", max(1, int(archive_bytes / average))).text(path))


def records(archive: bytes | memoryview) -> Iterator[tuple[int, dict[str, str], memoryview]]:
    """(offset, headers in lower case, payload) of each record of an archive."""
    view, body, at = memoryview(archive), bytes(archive), 0
    while at < len(body):
        end = body.index(b"\r\n\r\n", at)
        lines = body[at:end].decode("utf-8").split(_CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start, size = end + 4, int(headers["content-length"])
        if body[start + size:start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} does not end where it says")
        yield at, headers, view[start:start + size]
        at = start + size + 4


def url_key(url: str | None) -> str:
    """Host labels reversed, then the path: captures of a site and page sort together."""
    if not url:
        return ""
    rest = url.partition("://")[2] or url
    host, slash, path = rest.partition("/")
    labels = host.lower().partition(":")[0].removeprefix("www.").split(".")
    return ",".join(reversed(labels)) + ")" + slash + path.partition("#")[0]


def _id(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def index_runs(spark, path: str) -> DataFrame:
    """One run of index rows per archive under ``path``, sorted by url key, time and id.

    Digests and lengths of responses are taken from the payloads read back, and must
    equal what the record states.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from datetime import datetime
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                rows = []
                for _, head, payload in records(content.as_buffer()):
                    stated = head["warc-payload-digest"].removeprefix("sha1:")
                    kind = head["warc-type"]
                    digest, size = stated, int(head.get("warc-payload-length", len(payload)))
                    if kind == "response":
                        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if digest != stated:
                            raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
                    rows.append((url_key(head.get("warc-target-uri")),
                                 datetime.fromisoformat(head["warc-date"].replace("Z", "+00:00")),
                                 _id(head["warc-record-id"]), size, digest, kind, _id(head.get("warc-refers-to"))))
                rows.sort(key=_order)
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
                kinds = [pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)),
                     pa.array([name] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64())],
                    [x.split()[0] for x in INDEX.split(", ")])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, INDEX)


def _order(row: tuple) -> tuple:
    return row[0], row[1], -1 if row[2] is None else row[2]


class LoserTree:
    """Merges sorted runs; a next item costs one comparison for each level of the tree."""

    def __init__(self, runs: list[list], key) -> None:
        self.runs, self.key = runs, key
        self.at = [0] * len(runs)
        self.heads = [key(r[0]) if r else None for r in runs]
        self.losers = [-1] * max(1, len(runs))
        self.winner = self._play(1)

    def _beats(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        if a is None or b is None:
            return b is None and (a is not None or i < j)
        return a < b or a == b and i < j

    def _play(self, node: int) -> int:
        n = len(self.runs)
        if node >= n:
            return node - n
        left, right = self._play(2 * node), self._play(2 * node + 1)
        if self._beats(left, right):
            self.losers[node] = right
            return left
        self.losers[node] = left
        return right

    def __iter__(self) -> Iterator:
        if not self.runs:
            return
        winner = self.winner if len(self.runs) > 1 else 0
        while self.heads[winner] is not None:
            run = self.runs[winner]
            yield run[self.at[winner]]
            self.at[winner] += 1
            at = self.at[winner]
            self.heads[winner] = self.key(run[at]) if at < len(run) else None
            node = (winner + len(self.runs)) // 2
            while node:
                if self._beats(self.losers[node], winner):
                    self.losers[node], winner = winner, self.losers[node]
                node //= 2


def merge_runs(runs: DataFrame, per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """The runs as one index in global order: by url key, time, page id and run.

    Rows are dealt to ranges of about ``per_range`` rows of the whole sort key, so a url
    with very many captures is cut by time; each range gets a slice of every run, in the
    run's order, and merges the slices with a loser tree.  ``part`` and ``at`` number
    ranges and places within them in the global order.
    """
    ranges = max(1, -(-runs.count() // per_range))
    order = [F.col("urlkey"), F.col("captured"), F.coalesce("page_id", F.lit(-1)), F.col("run"), F.col("place")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        slices: dict[str, list[tuple]] = {}
        keys = zip(*(table[c].to_pylist() for c in ("urlkey", "captured", "page_id", "run", "place")), strict=True)
        for i, (url, time, page, name, place) in enumerate(keys):
            slices.setdefault(name, []).append((url, time, page, name, place, i))
        for part in slices.values():  # a slice comes in one or more blocks of its run
            part.sort(key=lambda x: x[4])
        merged = list(LoserTree([slices[name] for name in sorted(slices)], _order))
        out = table.take(pa.array([x[5] for x in merged], pa.int64()))
        out = out.append_column("part", pa.array([TaskContext.get().partitionId()] * len(out), pa.int32()))
        yield from out.append_column("at", pa.array(range(len(out)), pa.int64())).to_batches(max_chunksize=50_000)

    return runs.repartitionByRange(ranges, *order).mapInArrow(run, INDEX + ", part int, at long")


def capture_histories(merged: DataFrame) -> DataFrame:
    """``merged`` with ``position`` in the whole index and ``capture_no`` within the url key, from 0.

    Places within a range are known; what earlier ranges hold is added from a summary of
    one row a range, so no url key is gathered in a task.
    """
    ends = merged.groupBy("part").agg(
        F.count("*").alias("n"), F.min("urlkey").alias("first"), F.max("urlkey").alias("last"))
    of_last = merged.join(ends.select("part", F.col("last").alias("urlkey")), ["part", "urlkey"], "left_semi").groupBy(
        "part").agg(F.count("*").alias("n_last"))
    first_at = merged.groupBy("part", "urlkey").agg(F.min("at").alias("from"))
    by_part = Window.orderBy("part")  # a row a range
    so_far = Window.partitionBy("last").orderBy("part")
    summed = ends.join(of_last, "part").withColumn("of_key", F.sum("n_last").over(so_far))
    summed = summed.select(
        "part", "first", (F.sum("n").over(by_part) - F.col("n")).alias("before"),
        F.when(F.lag("last").over(by_part) == F.col("first"), F.lag("of_key").over(by_part)).otherwise(0).alias("carried"))
    return (merged.join(first_at, ["part", "urlkey"]).join(summed, "part").withColumn(
        "position", F.col("before") + F.col("at")).withColumn(
        "capture_no", F.col("at") - F.col("from") + F.when(F.col("urlkey") == F.col("first"), F.col("carried")).otherwise(0))
        .drop("part", "at", "from", "first", "before", "carried"))


def archive_and_index(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes ``pages`` to archives, reads them back and returns the merged index with histories.

    Archives, runs and the merged index are tables in the shared folder.  An empty table
    of pages gives an empty index; other columns are not read.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, least)
    runs = scratch_path(spark, "runs")
    index_runs(spark, path).write.parquet(runs)
    merged = scratch_path(spark, "index")
    merge_runs(spark.read.parquet(runs)).write.parquet(merged)
    return capture_histories(spark.read.parquet(merged))
