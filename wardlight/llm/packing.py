"""Best-two-fit packing of token sequences."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.bpe import ENCODED_BYTES, Encoder, tables
from wardlight.llm.words import sliced, spread
from wardlight.session import scratch_path

PIECES_PER_SHARD = 100_000


def token_pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0,
                 key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's ids and ``end_id``, cut into pieces of at most ``size`` ids.

    Rows (key, piece, start, length, ids_crc32, salt); ``salt`` is the row's number in
    its task.  Null and empty texts have the one id ``end_id``.
    """
    given = docs.sparkSession.sparkContext.broadcast(tables(tokenizer))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, salt = Encoder(given.value), 0
        for batch in sliced(batches, most=ENCODED_BYTES):
            per_row, lengths, starts, pool = encode(batch["text"])
            upto = np.append(0, np.cumsum(lengths))
            ends = np.append(0, np.cumsum(per_row))
            stop = upto[ends[1:]] + np.arange(1, batch.num_rows + 1)
            ids = np.full(int(stop[-1]), end_id, "<u4")
            filled = np.ones(len(ids), bool)
            filled[stop - 1] = False
            ids[filled] = pool[spread(starts, lengths)]
            begin = np.append(0, stop[:-1])
            n = -(-(stop - begin) // size)
            row = np.repeat(np.arange(batch.num_rows), n)
            piece = spread(np.zeros(len(n), np.int64), n)
            offset = piece * size
            length = np.minimum(size, (stop - begin)[row] - offset)
            view = memoryview(ids).cast("B")
            crc = [zlib.crc32(view[4 * a:4 * b]) for a, b in
                   zip((begin[row] + offset).tolist(), (begin[row] + offset + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch["key"].take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(offset, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                 pa.array(salt + np.arange(len(row)), pa.int64())],
                ["key", "piece", "start", "length", "ids_crc32", "salt"])
            salt += len(row)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"key {kind}, piece int, start long, length long, ids_crc32 long, salt long")


def best_two_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length.

    A bin takes the longest piece left that fits until none does.  While a gap
    remains, its smallest piece is swapped for the two pieces left that together fill
    gap and place better than it did.  Ties go to the longer first piece.
    """
    order = np.argsort(-lengths, kind="stable")
    left = np.bincount(lengths, minlength=size + 1)
    at = np.cumsum(left[::-1])[::-1] - left
    available = np.flatnonzero(left).tolist()
    fit = np.zeros(size + 1, np.int64)
    for low, high in zip(available, [*available[1:], size + 1], strict=True):
        fit[low:high] = low
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def take(length: int) -> None:
        left[length] -= 1
        if not left[length]:
            k = bisect_right(available, length) - 1
            available.pop(k)
            fit[length:available[k] if k < len(available) else size + 1] = available[k - 1] if k else 0

    def give(length: int) -> None:
        left[length] += 1
        if left[length] == 1:
            k = bisect_right(available, length)
            available.insert(k, length)
            fit[length:available[k + 1] if k + 1 < len(available) else size + 1] = length

    def pair(room: int) -> tuple[int, int]:
        """The two lengths left with the greatest sum up to ``room``, else zeros."""
        first = np.array(available[:bisect_right(available, room)], np.int64)
        if not len(first):
            return 0, 0
        second = fit[room - first]
        same = (second == first) & (left[first] < 2)
        second[same] = fit[first[same] - 1]
        total = np.where(second > 0, first + second, 0)
        best = len(total) - 1 - int(np.argmax(total[::-1]))
        return (int(first[best]), int(second[best])) if total[best] else (0, 0)

    used, number, done = np.zeros(size + 1, np.int64), 0, 0
    while done < len(lengths):
        content, gap = [], size
        while gap and (length := int(fit[gap])):
            take(length)
            content.append(length)
            gap -= length
        while gap and available:
            smallest = content[-1]
            a, b = pair(gap + smallest)
            if a + b <= smallest:
                break
            content.pop()
            for x in (a, b):
                take(x)
            give(smallest)
            content += sorted((a, b), reverse=True)
            content.sort(reverse=True)
            gap += smallest - a - b
        offset = 0
        for length in content:
            row = order[at[length] + used[length]]
            used[length] += 1
            bins[row], offsets[row] = number, offset
            offset += length
        done += len(content)
        number += 1
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, key: str = "doc_id",
         text: str = "text", per_shard: int = PIECES_PER_SHARD) -> DataFrame:
    """Every document's pieces with their place in a sequence of at most ``size`` ids.

    The pieces (numbers only) are written once to the shared folder and dealt by hash
    over shards of about ``per_shard`` pieces, each packed on its own: a shard's memory
    does not grow with the input, and it costs one unfilled sequence for tens of
    thousands.  Whole texts stay whole below ``size`` ids.

    Rows (key, piece, start, length, ids_crc32, sequence_id, offset), one a piece.
    Repeated rows are packed as often as they occur; an empty table gives no rows.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "pieces")
    token_pieces(docs, tokenizer, size, end_id, key, text).write.parquet(path)
    pieces = spark.read.parquet(path)
    shards = max(1, -(-pieces.count() // per_shard))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([
            ("length", "descending"), ("ids_crc32", "ascending"), ("key", "ascending"), ("piece", "ascending"),
            ("salt", "ascending")])
        bins, offsets = best_two_fit(table["length"].to_numpy(), size)
        sequence = (np.int64(TaskContext.get().partitionId()) << 32) + bins
        out = table.drop_columns(["salt"]).append_column("sequence_id", pa.array(sequence, pa.int64()))
        yield from out.append_column("offset", pa.array(offsets, pa.int64())).to_batches(max_chunksize=50_000)

    kind = docs.schema[key].dataType.simpleString()
    dealt = pieces.repartition(shards, F.xxhash64("key", "piece", "ids_crc32", "salt"))
    return dealt.mapInArrow(
        run, f"key {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    ).withColumnRenamed("key", key)
