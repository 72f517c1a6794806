"""Repeated byte strings by suffix order: two-stage sorting of suffixes, then adjacent common prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.words import sliced, spread, text_bytes
from wardlight.session import scratch_path

LENGTH = 400
#: Bytes hashed at each place to choose the places that strings are dealt by.
GRAM = 8
#: Text that a task turns at once; a longer text goes in sections of as many strings.
SECTION = 1 << 20
#: Distinct segments around one core that are sorted together; more of them are told apart string by string.
MOST_SEGMENTS = 1_000
#: Segments a task, and bytes sorted at once.
TASK_SEGMENTS, SORTED_BYTES = 20_000, 2 << 20
#: Ends a segment; no UTF-8 text holds it.
END = 0xFF
#: Bits of the filter that keeps rows nobody asks for out of a shuffle, and bits a row of it.
FILTER_BITS, ROW_BITS = 1 << 25, 1 << 15

_MIX = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64(2**28 - 1)


# -- suffix order of one text ----------------------------------------------------------------------------------------

def _chunks(text: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as a big-endian number, zeros beyond the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i:i + len(text)]
    return out


def _chunk_at(chunks: np.ndarray, at: np.ndarray) -> np.ndarray:
    inside = at < len(chunks)
    return np.where(inside, chunks[np.where(inside, at, 0)], np.uint64(0))


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """For each suffix whether it is smaller than its successor; the last one counts as smaller."""
    n = len(text)
    differs = np.flatnonzero(text[1:] != text[:-1])
    smaller = np.ones(n, bool)
    if len(differs):
        up = text[differs] < text[differs + 1]
        runs = np.diff(differs, prepend=-1)
        smaller[:differs[-1] + 1] = np.repeat(up, runs)
    return smaller


def _sorted_directly(chunks: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` in the order of their first ``depth`` bytes, eight at a time; only ties go on."""
    key = chunks[places]
    order = np.argsort(key, kind="stable")
    out, key = places[order], key[order]
    first = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    slot = np.arange(len(out))
    for step in range(8, depth, 8):
        # rows alone in their group are settled
        size = np.diff(np.flatnonzero(np.r_[first, True]))
        tied = np.repeat(size > 1, size)
        slot, first = slot[tied], first[tied]
        if not len(slot):
            break
        key = _chunk_at(chunks, out[slot] + step)
        starts = np.flatnonzero(first)
        group = np.cumsum(first) - 1
        uneven = (np.minimum.reduceat(key, starts) != np.maximum.reduceat(key, starts))[group]
        at = np.flatnonzero(uneven)
        if len(at):
            order = at[np.lexsort((key[at], group[at]))]
            out[slot[at]] = out[slot[order]]
            key[at] = key[order]
            first = first | np.r_[True, key[1:] != key[:-1]]
    return out


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The ``wanted`` places (a mask) in the order of their suffixes' first ``depth`` bytes.

    Two stages.  Suffixes smaller than their successors are sorted directly, the others
    are induced: a larger one starts with a byte not below its successor's, so a scan of
    the buckets of first bytes in rising order meets every successor first and appends
    the suffix before it to that one's bucket.  Inside a bucket induced suffixes stand
    before the sorted ones.  A suffix that isn't wanted is ranked only where a wanted
    one is induced from it.  ``text`` ends with ``END``.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    smaller = smaller_than_next(text)
    bases = np.flatnonzero(smaller)
    asked = np.flatnonzero(wanted)
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, asked, 1)
    np.add.at(covered, bases[np.searchsorted(bases, asked)] + 1, -1)
    needed = np.cumsum(covered[:n]) > 0
    direct = _sorted_directly(_chunks(text), np.flatnonzero(needed & smaller), depth)
    cuts = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    ranked = []

    def append_before(places: np.ndarray) -> None:
        """Hands the larger suffixes before ``places`` to the buckets of their first bytes."""
        before = places[places > 0] - 1
        before = before[needed[before] & ~smaller[before]]
        if not len(before):
            return
        before = before[np.argsort(text[before], kind="stable")]
        heads = text[before]
        for part in np.split(before, np.flatnonzero(heads[1:] != heads[:-1]) + 1):
            induced[text[part[0]]].append(part)

    for bucket in range(256):
        done = 0
        while done < len(induced[bucket]):  # a run of one byte induces into its own bucket
            append_before(induced[bucket][done])
            done += 1
        own = direct[cuts[bucket]:cuts[bucket + 1]]
        ranked += [*induced[bucket], own]
        if len(own):
            append_before(own)
        induced[bucket] = []
    order = np.concatenate(ranked)
    return order[wanted[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each place of ``order`` has in common with the one before it, up to ``depth``; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    chunks = _chunks(text)
    at = np.arange(1, len(order))
    for step in range(0, depth, 8):
        x, y = order[at - 1] + step, order[at] + step
        mixed = _chunk_at(chunks, x) ^ _chunk_at(chunks, y)
        same = mixed == 0
        out[at[~same]] = step + sum((mixed[~same] >> np.uint64(64 - 8 * k) == 0).astype(np.int64) for k in range(1, 8))
        at = at[same]
        out[at] = step + 8
        if not len(at):
            break
    latest = np.maximum(order[1:], order[:-1])
    out[1:] = np.minimum(np.minimum(out[1:], depth), len(text) - latest)
    return out


def repeated_places(text: np.ndarray, wanted: np.ndarray, length: int) -> np.ndarray:
    """A mask of the ``wanted`` places whose next ``length`` bytes also start at another wanted place."""
    order = suffix_order(text, wanted, length)
    same = np.flatnonzero(common_prefixes(text, order, length) >= length)
    out = np.zeros(len(text), bool)
    out[order[same]] = True
    out[order[same - 1]] = True
    return out


# -- dealing the strings of a corpus out -----------------------------------------------------------------------------

def segments(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, how many, core) of each run of ``length``-byte strings that have their core at one place.

    A string's core starts at the place of the least hash among its first ``length // 2``
    places, so it follows from the string's own bytes: equal strings have equal cores at
    equal distance.  A core is as long as all strings that share it go on after its start.
    """
    width = length // 2
    n = len(data)
    padded = np.concatenate([data, np.zeros(width + GRAM, np.uint8)])
    gram = np.zeros(n + width, np.uint64)
    for i in range(GRAM):
        gram = (gram << np.uint64(8)) | padded[i:i + n + width]
    gram *= _MIX
    gram ^= gram >> np.uint64(29)
    gram *= _MIX
    key = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
    key = np.concatenate([key, np.full(-len(key) % width, 2**64 - 1, np.uint64)]).reshape(-1, width)
    upto = np.minimum.accumulate(key, 1).ravel()
    after = np.minimum.accumulate(key[:, ::-1], 1)[:, ::-1].ravel()
    core = (np.minimum(after[:n], upto[width - 1:width - 1 + n]) & _PLACE).astype(np.int64)
    many = np.maximum(np.diff(ends) - length + 1, 0)
    start = spread(ends[:-1], many)
    core = core[start]
    new = np.ones(len(start), bool)
    new[1:] = (core[1:] != core[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    return start[first], np.diff(first, append=len(start)), core[first]


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=8).digest()


def texts_of(docs: DataFrame, text: str) -> DataFrame:
    """(f1, f2, text): texts with a 128-bit fingerprint; equal texts fare alike, so they are known by it."""
    body = F.col(text).cast("string")
    return docs.select(F.xxhash64(body).alias("f1"), F.xxhash64(F.lit(12), body).alias("f2"), body.alias("text"))


def dealt(texts: DataFrame, length: int) -> DataFrame:
    """(key, seg, f1, f2, many, at): the segments of ``texts`` (f1, f2, text); map-only.

    ``key`` is the hash of a core, ``seg`` that of all bytes of the strings around it,
    ``many`` the number of these strings, ``at`` the places of the first one in the text
    (more than one where the text repeats itself).
    """
    size = length - length // 2 + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=SECTION):
            data, ends = text_bytes(batch["text"])
            for base in range(0, max(1, len(data)), SECTION):
                part = data, ends
                if len(data) > SECTION:  # one long text
                    piece = data[base:base + SECTION + length - 1]
                    part = piece, np.array([0, len(piece)])
                start, many, core = segments(*part, length)
                if not len(start):
                    continue
                raw = part[0].tobytes()
                key = np.frombuffer(b"".join([_digest(raw[c:c + size]) for c in core.tolist()]), np.int64)
                ends_ = start + many + length - 1
                seg = np.frombuffer(b"".join([_digest(raw[x:y]) for x, y in zip(start.tolist(), ends_.tolist(), strict=True)]), np.int64)
                row = np.searchsorted(part[1], start, side="right") - 1
                order = np.lexsort((start, seg, key, row))
                row, key, seg, start, many = row[order], key[order], seg[order], start[order], many[order]
                new = np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1]) | (seg[1:] != seg[:-1])]
                first = np.flatnonzero(new)
                own = pa.array(row[first])
                places = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(start - part[1][row] + base))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[first]), pa.array(seg[first]), batch["f1"].take(own), batch["f2"].take(own),
                     pa.array(many[first], pa.int32()), places], ["key", "seg", "f1", "f2", "many", "at"])

    return texts.where(F.octet_length("text") >= length).mapInArrow(
        run, "key long, seg long, f1 long, f2 long, many int, at array<long>")


def maybe(rows: DataFrame, key: Column, asked: DataFrame) -> DataFrame:
    """``rows`` with a column ``__maybe``: false only where the key isn't among the ``asked`` (key).

    It comes from a broadcast bitmap of hashed keys, ``FILTER_BITS`` whatever the input;
    where there are far more keys than bits it is true everywhere.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bits = asked.groupBy(F.floor(place(F.col("key")) / ROW_BITS).alias("__row")).agg(
        F.bitmap_construct_agg(F.pmod(place(F.col("key")), F.lit(ROW_BITS))).alias("__bits"))
    joined = rows.join(F.broadcast(bits), F.floor(place(key) / ROW_BITS) == F.col("__row"), "left")
    bit = F.pmod(place(key), F.lit(ROW_BITS))
    byte = F.conv(F.hex(F.substring("__bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))), F.lit(2)) == 1
    return joined.withColumn("__maybe", F.coalesce(set_, F.lit(False))).drop("__row", "__bits")


# -- the corpus ------------------------------------------------------------------------------------------------------

def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _bodies(texts: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """The ``asked`` segments (key, seg, times, wide, f1, f2, start, many) with their bytes, from one row of each text."""
    lists = asked.groupBy("f1", "f2").agg(F.collect_list(F.struct("key", "seg", "times", "wide", "start", "many")).alias("of"))
    one = maybe(texts, F.col("f1"), asked.select(F.col("f1").alias("key"))).where("__maybe").groupBy("f1", "f2").agg(
        F.first("text").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=SECTION):
            data, ends = text_bytes(batch["text"])
            raw = data.tobytes()
            row = pa.array(np.repeat(np.arange(batch.num_rows), batch["of"].value_lengths().to_numpy()))
            of = dict(zip(("key", "seg", "times", "wide", "start", "many"), batch["of"].flatten().flatten(), strict=True))
            first = ends[:-1][row.to_numpy()]
            for low in range(0, len(row), 2_000):
                cut = slice(low, low + 2_000)
                at = first[cut] + of["start"].to_numpy()[cut]
                upto = at + of["many"].to_numpy()[cut] + length - 1
                body = [raw[x:y] for x, y in zip(at.tolist(), upto.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(of[c][cut] for c in ("key", "seg", "times", "wide")), batch["f1"].take(row[cut]), batch["f2"].take(row[cut]),
                     of["start"][cut], pa.array(body, pa.binary())],
                    ["key", "seg", "times", "wide", "f1", "f2", "start", "body"])

    return one.join(lists, ["f1", "f2"]).select("f1", "f2", "text", "of").mapInArrow(
        run, "key long, seg long, times long, wide boolean, f1 long, f2 long, start long, body binary")


def _by_suffixes(bodies: DataFrame, length: int) -> DataFrame:
    """(f1, f2, start, end) of the single segments' repeated strings, by the suffix order of each task's cores.

    A core's segments are in one task, so equal strings meet.  Segments come sorted by
    core and are sorted together up to ``SORTED_BYTES``.
    """
    tasks = max(1, -(-bodies.count() // TASK_SEGMENTS))

    def ranked(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(r[4]) for r in rows])
        offset = np.cumsum(sizes + 1) - sizes - 1
        text = np.frombuffer(b"".join(r[4] + bytes([END]) for r in rows), np.uint8)
        wanted = np.zeros(len(text), bool)
        wanted[spread(offset, sizes - length + 1)] = True
        found = repeated_places(text, wanted, length)
        single = np.array([r[0] == 1 for r in rows])
        low = np.flatnonzero(found & ~np.r_[False, found[:-1]])
        high = np.flatnonzero(found & ~np.r_[found[1:], False])
        of = np.searchsorted(offset, low, side="right") - 1
        use = single[of]
        of, low, high = of[use], low[use] - offset[of[use]], high[use] - offset[of[use]]
        start = np.array([r[3] for r in rows], np.int64)[of]
        yield pa.RecordBatch.from_arrays(
            [pa.array([rows[i][1] for i in of], pa.int64()), pa.array([rows[i][2] for i in of], pa.int64()),
             pa.array(start + low), pa.array(start + high + length)], ["f1", "f2", "start", "end"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, last = [], 0, None
        for batch in sliced(batches, "body", SECTION):
            columns = [batch[c].to_pylist() for c in ("key", "times", "f1", "f2", "start", "body")]
            for key, *row in zip(*columns, strict=True):
                if key != last and held >= SORTED_BYTES:
                    yield from ranked(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[4])
                last = key
        if rows:
            yield from ranked(rows)

    dealt_out = bodies.select("key", "times", "f1", "f2", "start", "body").repartition(tasks, "key").sortWithinPartitions("key")
    return dealt_out.mapInArrow(run, "f1 long, f2 long, start long, end long")


def _by_strings(bodies: DataFrame, length: int) -> DataFrame:
    """The same for cores with too many segments for one task: their strings one by one, counted before they move."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "body", 1 << 16):
            many = pc.binary_length(batch["body"]).to_numpy() - length + 1
            own = pa.array(np.repeat(np.arange(batch.num_rows), many))
            digests = b"".join([hashlib.blake2b(body[i:i + length], digest_size=16).digest()
                                for body, m in zip(batch["body"].to_pylist(), many.tolist(), strict=True) for i in range(m)])
            words = np.frombuffer(digests, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words[:, 0]), pa.array(words[:, 1]), batch["times"].take(own), batch["f1"].take(own),
                 batch["f2"].take(own), pa.array(spread(batch["start"].to_numpy(), many))],
                ["w1", "w2", "times", "f1", "f2", "start"])

    strings = _written(bodies.select("times", "f1", "f2", "start", "body").mapInArrow(
        run, "w1 long, w2 long, times long, f1 long, f2 long, start long"), "strings")
    again = _written(strings.groupBy("w1", "w2").agg(F.sum("times").alias("n")).where("n > 1").select("w1", "w2"), "again")
    return strings.where("times = 1").join(again, ["w1", "w2"]).select("f1", "f2", "start", (F.col("start") + length).alias("end"))


def find_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text") -> DataFrame:
    """(f1, f2, spans): byte ranges, unmerged, of the strings of ``length`` bytes that start more than once.

    ``f1, f2`` are the fingerprints of ``texts_of``; texts without such a string have no row.

    Strings are dealt out by their cores (``segments``).  Cores met once are dropped.
    Equal segments are counted as one before anything moves: all strings of a segment
    met more than once are repeated.  Different segments around one core are sorted by
    suffix, two-stage, and a string is repeated where it has ``length`` bytes in common
    with its neighbour.  A core with more than ``MOST_SEGMENTS`` different ones has its
    strings counted one by one, so no task holds more than that many.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    texts = texts_of(docs, text)
    every = _written(dealt(texts, length), "segments")
    met = _written(every.groupBy("key").agg(F.sum(F.size("at")).alias("n")).where("n > 1").select("key"), "met")
    members = _written(maybe(every, F.col("key"), met).where("__maybe").drop("__maybe").join(met, "key"), "members")
    kinds = _written(members.groupBy("key", "seg").agg(
        F.sum(F.size("at")).alias("times"), F.min(F.struct("f1", "f2", F.element_at("at", 1).alias("start"), "many")).alias("one")), "kinds")
    # written, so that Spark can split a crowded core when it joins
    around = _written(kinds.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "around")
    asked = _written(kinds.join(around, "key").select("key", "seg", "times", (F.col("n") > MOST_SEGMENTS).alias("wide"), "one.*"), "asked")
    bodies = _written(_bodies(texts, asked, length), "bodies")
    whole = _written(kinds.where("times > 1").select("key", "seg"), "whole")
    copied = members.join(whole, ["key", "seg"]).select("f1", "f2", "many", F.explode("at").alias("start")).select(
        "f1", "f2", "start", (F.col("start") + F.col("many") + (length - 1)).alias("end"))
    spans = (copied.unionByName(_by_suffixes(bodies.where("not wide"), length))
             .unionByName(_by_strings(bodies.where("wide"), length)))
    return spans.groupBy("f1", "f2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept): each row's text without the bytes of repeated strings.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else,
    in the same text or another one; all copies lose it.  ``kept`` is binary: a cut may
    stand inside a character.  A null text is empty.  Rows with equal texts repeat each
    other, whatever their ids; null and repeated ids are rows like others.
    """
    found = _written(find_repeats(docs, length, text), "spans")
    body = F.col(text).cast("string")
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(body).alias("f1"), F.xxhash64(F.lit(12), body).alias("f2"), body.alias("text"))
    marked = maybe(rows, F.col("f1"), found.select(F.col("f1").alias("key")))
    hit = marked.where("__maybe").drop("__maybe").join(found, ["f1", "f2"], "left").select("key", "text", "spans")
    free = marked.where("not __maybe").select("key", "text", F.lit(None).cast(found.schema["spans"].dataType).alias("spans"))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=4 * SECTION):
            out: list[list] = [[], [], [], []]
            for text_, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                raw = (text_ or "").encode()
                kept, upto, runs = [], 0, 0
                for s in sorted((s["start"], s["end"]) for s in spans or ()):
                    if s[0] > upto or not runs:
                        kept.append(raw[upto:s[0]])
                        runs += 1
                    upto = max(upto, s[1])
                kept = b"".join([*kept, raw[upto:]])
                for column, value in zip(out, (len(raw), len(raw) - len(kept), runs, kept), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch["key"], *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())],
                [key, "n_bytes", "n_removed", "n_spans", "kept"])

    return hit.unionByName(free).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
