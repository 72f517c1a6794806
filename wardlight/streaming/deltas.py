"""An upserted table as batch deltas that are merged by level, under an atomic manifest."""

from __future__ import annotations

import json
import uuid
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession

from wardlight.operators.audit import latest_per_key

FANOUT = 4


class Segment(NamedTuple):
    """A folder of rows that are newest per key among the batches up to ``last`` that it covers."""

    folder: str
    level: int
    last: int


class DeltaTable:
    """Newest row per key over batches that come one after the other, by one writer.

    A batch becomes a segment of level 0.  ``fanout`` segments of a level are merged into
    one of the next, so a row is rewritten once a level and after n batches a read opens
    at most ``most_segments(n)`` folders.  What belongs to the table is told by the newest
    manifest alone, a small file that appears in one rename: a reader sees all of a batch
    and its merges or nothing, and a writer that was lost leaves folders nobody reads.  A
    batch number that the manifest has passed is ignored, so a repeated batch changes
    nothing.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], fanout: int = FANOUT) -> None:
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.spark, self.path, self.keys, self.order, self.fanout = spark, path.rstrip("/"), keys, order, fanout

    # -- manifests -------------------------------------------------------------------------------

    def _fs(self) -> tuple[Any, Any]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path, path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path, fs = self._fs()
        folder = path(f"{self.path}/manifest")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def segments(self, version: int | None = None) -> list[Segment]:
        """The folders of a version, the newest one by default."""
        known = self.versions()
        if not known:
            return []
        path, fs = self._fs()
        stream = fs.open(path(f"{self.path}/manifest/{known[-1] if version is None else version:012d}.json"))
        try:
            body = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Segment(*s) for s in json.loads(body)]

    def _commit(self, segments: list[Segment]) -> None:
        path, fs = self._fs()
        version = (self.versions() or [-1])[-1] + 1
        draft = path(f"{self.path}/manifest/{uuid.uuid4().hex}.draft")
        out = fs.create(draft)
        try:
            out.write(bytearray(json.dumps(segments).encode()))
        finally:
            out.close()
        if not fs.rename(draft, path(f"{self.path}/manifest/{version:012d}.json")):
            raise RuntimeError(f"version {version} of {self.path} exists: the table has a second writer")

    # -- rows ------------------------------------------------------------------------------------

    def _written(self, rows: DataFrame) -> str:
        folder = f"{self.path}/segment-{uuid.uuid4().hex}"
        latest_per_key(rows, self.keys, self.order).write.parquet(folder)
        return folder

    def add(self, batch: DataFrame, number: int) -> None:
        """Adds a batch; numbers rise, one that isn't above the last is a repetition."""
        segments = self.segments()
        if segments and number <= max(s.last for s in segments):
            return
        segments.append(Segment(self._written(batch), 0, number))
        level = 0
        while len(same := [s for s in segments if s.level == level]) >= self.fanout:
            merged = self._written(self.spark.read.parquet(*(s.folder for s in same)))
            segments = [s for s in segments if s.level != level] + [Segment(merged, level + 1, number)]
            level += 1
        self._commit(segments)

    def read(self, version: int | None = None) -> DataFrame:
        """The newest row per key, as of a version."""
        folders = [s.folder for s in self.segments(version)]
        if not folders:
            raise ValueError(f"{self.path} has no batch yet")
        return latest_per_key(self.spark.read.parquet(*folders), self.keys, self.order)

    def most_segments(self, batches: int) -> int:
        levels = 1
        while self.fanout**levels <= batches:
            levels += 1
        return (self.fanout - 1) * levels

    def vacuum(self, keep: int = 2) -> int:
        """Deletes segments that none of the newest ``keep`` versions holds, then older manifests."""
        path, fs = self._fs()
        known = self.versions()
        used = {s.folder.rsplit("/", 1)[1] for v in known[-keep:] for s in self.segments(v)}
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path))]
        gone = [n for n in names if n.startswith("segment-") and n not in used]
        for n in gone:
            fs.delete(path(f"{self.path}/{n}"), True)
        for v in known[:-keep]:
            fs.delete(path(f"{self.path}/manifest/{v:012d}.json"), False)
        return len(gone)
