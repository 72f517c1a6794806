"""Near-duplicate documents: an LSH forest of sorted MinHash orders, confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlight.llm.words import NONSPACE, sliced, words
from wardlight.session import scratch_path

HASHES = 64
TREES = 16
#: Neighbours looked at on each side in each sorted order.
REACH = 8
#: Hash bytes that two neighbours share at least at the head of an order.
DEPTH = 3
#: Depths at which a region of more than REACH rows is also compared with its centre.
CENTRES = (3, 5, 8, 13, 21)
#: Neighbours of a document confirmed in the first round, the likeliest first.
FIRST = 4
ROWS_PER_RANGE = 200_000
#: Text whose shingles a task holds at once; they take about forty times as much while they are made.
SLICE = 1 << 20
#: Rows of a region whose bytes are counted at once.
COUNTED = 10_000
#: Bits of the filter that keeps texts nobody asks for out of a shuffle, and bits a row of it.
FILTER_BITS, ROW_BITS = 1 << 24, 1 << 15
#: Hash buckets in which the shingles of crowded rows are counted, and buckets a row of their table.
BUCKETS, BUCKET_BITS, ROW_BUCKETS = 1 << 22, 22, 1 << 16

_random = np.random.Generator(np.random.PCG64(7_2024))
_XOR = _random.integers(0, 2**64, HASHES, np.uint64)
_ODD = _random.integers(0, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_JOIN = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
ORDERS = np.stack([_random.permutation(HASHES) for _ in range(TREES)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_sets(text: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles per row, ascending distinct 64-bit shingle hashes row by row)."""
    found = words(text, NONSPACE)
    n = found.per_row
    first = np.cumsum(n) - n
    value = _mixed(found.hashes)
    if not len(value):
        return np.zeros(len(n), np.int64), value
    wide = np.zeros(len(value), np.uint64)
    for k in range(size):
        wide[:len(value) - k] += np.roll(value, -k)[:len(value) - k] * (_JOIN[k % 3] + np.uint64(2 * k))
    parts = []
    for a, m in zip(first.tolist(), n.tolist(), strict=True):
        if m >= size:
            parts.append(np.sort(wide[a:a + m - size + 1]))
        elif m:
            whole = np.uint64(m)
            for v in value[a:a + m]:
                whole = np.uint64((int(whole) * int(_MIX) + int(v)) % 2**64)
            parts.append(np.array([whole], np.uint64))
    row = np.repeat(np.flatnonzero(n), [len(p) for p in parts])
    every = _mixed(np.concatenate(parts))
    order = np.concatenate(parts)
    new = np.r_[True, (order[1:] != order[:-1]) | (row[1:] != row[:-1])]
    return np.bincount(row[new], minlength=len(n)), every[new]


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(key, n, f1, f2, sketch): the set's size, a 128-bit fingerprint, HASHES MinHash bytes."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=SLICE):
            n, shingles = shingle_sets(batch["text"], size)
            full = np.flatnonzero(n)
            at = np.cumsum(n[full]) - n[full]
            f = np.zeros((2, len(n)), np.uint64)
            sketch = np.zeros((len(n), HASHES), np.uint8)
            if len(full):
                f[0, full] = np.add.reduceat(shingles, at)
                f[1, full] = np.add.reduceat(_mixed(shingles ^ _XOR[0]), at)
                for k in range(HASHES):
                    low = np.minimum.reduceat((shingles ^ _XOR[k]) * _ODD[k], at)
                    sketch[full, k] = (low * _MIX) >> np.uint64(56)
            body = pa.py_buffer(sketch.tobytes())
            ends = pa.py_buffer((np.arange(len(n) + 1) * HASHES).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch["key"], pa.array(n, pa.int64()), pa.array(f[0].view(np.int64)), pa.array(f[1].view(np.int64)),
                 pa.Array.from_buffers(pa.binary(), len(n), [None, ends, body])],
                ["key", "n", "f1", "f2", "sketch"])

    return docs.mapInArrow(run, "key long, n long, f1 long, f2 long, sketch binary")


def neighbours(ids: np.ndarray, sketch: np.ndarray, sizes: np.ndarray, roots: np.ndarray, least: int, percent: int,
               nearest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows near each other in a sorted order: (a, b, bytes in which they agree).

    They agree in ``least`` bytes, have different roots, and their sets' sizes don't rule the
    similarity out.  With ``nearest`` only rows side by side are compared.

    Pairs are of two kinds.  Each row is compared with the ``REACH`` rows before and after
    it; in a dense region those are the ones most like it.  And each row of a region of
    more than ``REACH`` rows with a common prefix is compared with the region's centre,
    the row that agrees best with the commonest bytes: two copies of one text that
    differ in other places are linked only if both are near that text, and rarely stand
    side by side.  Both grow in proportion to the rows.

    A row that has ``REACH`` rows like it on one side may have more beyond; it is crowded and
    comes back as the pair (row, row), score 0, for ``unmet``.
    """
    n = len(ids)
    a, b, score, marks = [], [], [], ids[:0]
    if n < 2:
        return ids[:0], ids[:0], np.zeros(0, np.int32)
    differ = sketch[1:] != sketch[:-1]
    lcp = np.where(differ.any(1), differ.argmax(1), sketch.shape[1])
    shared = lcp.copy()
    for step in range(1, min(1 if nearest else REACH, n - 1) + 1):
        if step > 1:
            shared = np.minimum(shared[1:], lcp[:n - step])
        at = np.flatnonzero(shared >= DEPTH)
        if not len(at):
            break
        if step == REACH:
            crowded = np.zeros(n, bool)
            crowded[at] = crowded[at + step] = True
            marks = ids[crowded]
        for part in np.array_split(at, max(1, len(at) // 100_000)):
            same = (sketch[part] == sketch[part + step]).sum(1)
            x, y = sizes[part], sizes[part + step]
            use = (same >= least) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & (roots[part] != roots[part + step])
            x, y = ids[part[use]], ids[part[use] + step]
            a.append(np.minimum(x, y))
            b.append(np.maximum(x, y))
            score.append(same[use].astype(np.int32))
    for depth in () if nearest else CENTRES:
        cuts = np.r_[0, np.flatnonzero(lcp < depth) + 1, n]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if high - low > REACH + 1:
                block = sketch[low:high]
                place = 256 * np.arange(block.shape[1])
                counts = sum(np.bincount((block[i:i + COUNTED] + place).ravel(), minlength=256 * block.shape[1])
                             for i in range(0, len(block), COUNTED))
                commonest = counts.reshape(-1, 256).argmax(1)
                centre = int((block == commonest).sum(1).argmax())
                same = (block == block[centre]).sum(1)
                x, y = sizes[low:high], sizes[low + centre]
                use = np.flatnonzero((same >= least) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))
                                     & (roots[low:high] != roots[low + centre]))
                a.append(np.minimum(ids[low + use], ids[low + centre]))
                b.append(np.maximum(ids[low + use], ids[low + centre]))
                score.append(same[use].astype(np.int32))
    if not a:
        return ids[:0], ids[:0], np.zeros(0, np.int32)
    a, b, score = np.concatenate(a), np.concatenate(b), np.concatenate(score)
    a, b, score = a[a != b], b[a != b], score[a != b]
    return np.append(a, marks), np.append(b, marks), np.append(score, np.zeros(len(marks), np.int32))


def candidates(sets: DataFrame, percent: int, nearest: bool = False) -> DataFrame:
    """Pairs (a, b, score), a < b, of the representatives ``sets`` (key, n, sketch, root), and (a, a, 0) of crowded ones.

    Rows of one root are no pair.  With ``nearest`` only rows that stand side by side in
    an order are, and none is crowded.

    Every tree is one order of the hash bytes.  All rows of all trees are range
    sorted together, by tree, bytes and id, so a large region is spread over tasks; each
    row is compared with its ``REACH`` neighbours of longest common prefix on both
    sides.  How deep that prefix goes follows the region: neighbours share ``DEPTH``
    bytes where few documents are alike and far more in a dense region.  Rows at the
    edge of a task are handed on, so a task's edge loses no neighbours.
    """
    spark = sets.sparkSession
    expected = percent / 100
    least = int(HASHES * expected - 5 * (HASHES * expected * (1 - expected)) ** 0.5)
    rows = sets.count()
    ranges = max(1, -(-rows * TREES // ROWS_PER_RANGE))

    def spread_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            body = np.frombuffer(b"".join(batch["sketch"].to_pylist()), np.uint8).reshape(-1, HASHES)
            for tree in range(TREES):
                head = np.full((len(body), 1), tree, np.uint8)
                keys = np.hstack([head, body[:, ORDERS[tree]]])
                ends = (np.arange(len(body) + 1) * (HASHES + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.Array.from_buffers(pa.binary(), len(body), [
                        None, pa.py_buffer(ends), pa.py_buffer(keys.tobytes())]), batch["key"], batch["n"], batch["root"]],
                    ["order", "key", "n", "root"])

    ordered = (sets.select("key", "n", "sketch", "root").mapInArrow(spread_out, "order binary, key long, n long, root long")
               .repartitionByRange(ranges, "order", "key").sortWithinPartitions("order", "key"))

    def read(batches: Iterable[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        ids, sizes, roots, keys = [none], [none], [none], [np.zeros((0, HASHES + 1), np.uint8)]
        for batch in batches:
            ids.append(batch["key"].to_numpy())
            sizes.append(batch["n"].to_numpy())
            roots.append(batch["root"].to_numpy())
            keys.append(np.frombuffer(b"".join(batch["order"].to_pylist()), np.uint8).reshape(-1, HASHES + 1))
        return np.concatenate(ids), np.concatenate(sizes), np.concatenate(roots), np.concatenate(keys)

    def within(ids: np.ndarray, sizes: np.ndarray, roots: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [neighbours(ids[:0], keys[:0, 1:], sizes[:0], roots[:0], least, percent, nearest)]
        for tree in np.unique(keys[:, 0]).tolist():
            own = keys[:, 0] == tree
            found.append(neighbours(ids[own], keys[own, 1:], sizes[own], roots[own], least, percent, nearest))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def paired(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, roots, keys = read(batches)
        if not len(ids):
            return
        part = TaskContext.get().partitionId()
        a, b, score = within(ids, sizes, roots, keys)
        for at in range(0, len(a), 50_000):
            cut = slice(at, at + 50_000)
            m = len(a[cut])
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, pa.int32()), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.binary()), pa.array(a[cut]),
                 pa.array(b[cut]), pa.array(score[cut]), pa.nulls(m, pa.int64())], ["part", "head", "order", "a", "b", "score", "root"])
        for head, cut in ((True, slice(0, REACH)), (False, slice(max(0, len(ids) - REACH), None))):
            m = len(ids[cut])
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * m, pa.int32()), pa.array([head] * m), pa.array([k.tobytes() for k in keys[cut]]),
                 pa.array(ids[cut]), pa.array(sizes[cut]), pa.nulls(m, pa.int32()), pa.array(roots[cut])],
                ["part", "head", "order", "a", "b", "score", "root"])

    path = scratch_path(spark, "neighbours")
    ordered.mapInArrow(paired, "part int, head boolean, order binary, a long, b long, score int, root long").write.parquet(path)
    made = spark.read.parquet(path)
    edges = made.where("part is not null")
    parts = edges.select("part").distinct()
    following = parts.withColumn("next", F.lead("part").over(Window.orderBy("part")))  # a row a task
    seams = (edges.where("not head").join(following, "part").where("next is not null")
             .select(F.col("next").alias("seam"), "order", F.col("a").alias("key"), F.col("b").alias("n"), "root")
             .unionByName(edges.where("head").select(
                 F.col("part").alias("seam"), "order", F.col("a").alias("key"), F.col("b").alias("n"), "root")))

    def across(group: pa.Table) -> pa.Table:
        group = group.sort_by([("order", "ascending"), ("key", "ascending")])
        a, b, score = within(*read(group.to_batches()))
        return pa.table({"a": a, "b": b, "score": score})

    crossing = seams.groupBy("seam").applyInArrow(across, "a long, b long, score int")
    return (made.where("part is null").select("a", "b", "score").unionByName(crossing)
            .groupBy("a", "b").agg(F.max("score").alias("score")))


def asked_for(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The ``rows`` (key, ...) whose key is in ``asked`` (key, distinct).

    A bitmap of hashed keys, ``FILTER_BITS`` whatever the input, is broadcast first, so
    that most rows that nobody asks for stay out of the join's shuffle.
    """
    place = lambda: F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS))
    row, bit = F.floor(place() / ROW_BITS), F.pmod(place(), F.lit(ROW_BITS))
    bitmaps = asked.groupBy(row.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    likely = (rows.withColumn("bucket", row).join(F.broadcast(bitmaps), "bucket")
              .where(1 == F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))), F.lit(2)))
              .select(*rows.columns))
    return likely.join(asked, "key", "left_semi")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity.

    ``texts`` are (key, text) of the documents in question.  Both joins are on one id and
    AQE splits an id that is in many pairs.
    """
    left = texts.select(F.col("key").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("right"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(sliced(batches, "left", SLICE), "right", SLICE):
            (n, x), (m, y) = shingle_sets(batch["left"], size), shingle_sets(batch["right"], size)
            ex, ey = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(m))
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = x[ex[i]:ex[i + 1]], y[ey[i]:ey[i + 1]]
                if 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)):
                    common = len(np.intersect1d(p, q, assume_unique=True))
                    good[i] = 100 * common >= percent * (len(p) + len(q) - common)
            kept = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch["a"].filter(kept), batch["b"].filter(kept)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _bucket_counts(texts: DataFrame, size: int) -> np.ndarray:
    """How many shingles of ``texts`` fall in each of ``BUCKETS``; as large as that whatever the input."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in sliced(batches, most=SLICE):
            _, shingles = shingle_sets(batch["text"], size)
            bucket, n = np.unique(shingles >> np.uint64(64 - BUCKET_BITS), return_counts=True)
            counts[bucket.astype(np.int64)] += n
        blocks = counts.reshape(-1, ROW_BUCKETS)
        at = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([blocks[i].tobytes() for i in at], pa.binary())],
                                         ["block", "counts"])

    def summed(group: pa.Table) -> pa.Table:
        total = np.zeros(ROW_BUCKETS, np.int64)
        for body in group["counts"]:
            total += np.frombuffer(body.as_buffer(), np.int64)
        return pa.table({"block": group["block"][:1], "counts": pa.array([total.astype(np.uint32).tobytes()], pa.binary())})

    kind = "block int, counts binary"
    out = np.zeros((BUCKETS // ROW_BUCKETS, ROW_BUCKETS), np.uint32)
    for r in texts.select("text").mapInArrow(run, kind).groupBy("block").applyInArrow(summed, kind).collect():
        out[r["block"]] = np.frombuffer(r["counts"], np.uint32)
    return out.ravel()


def unmet(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b, score), a < b: all pairs of ``texts`` (key, text, root, weight) that can reach the similarity.

    Only pairs of different roots count; ``weight`` is the number of rows of a root.  An
    exact prefix-filter join.  Shingles are in one order, rarest bucket first.  Of a pair
    that reaches the similarity, the smaller set holds a shared shingle among its first
    n - 2p/(100+p) n + 1, the larger among its first n - p/100 n + 1, and from the first
    shared one on both have enough left.  What the rows of a template share stands behind
    the smaller set's places unless they do reach it, so their lists stay short; a list of
    one root is dropped, and of a longer one rows of its largest root aren't compared
    with each other.
    """
    spark = texts.sparkSession
    given = spark.sparkContext.broadcast(_bucket_counts(texts, size))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=SLICE):
            n, shingles = shingle_sets(batch["text"], size)
            count = given.value[(shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((shingles, count, row))
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            least = -(-percent * n // 100)
            use = (place < (n - least + 1)[row]) & (count[order] > 1)  # a bucket of one is shared with nobody
            at, of = order[use], pa.array(row[use])
            for low in range(0, len(at), 100_000):
                cut = slice(low, low + 100_000)
                whose = of[cut]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shingles[at[cut]].view(np.int64)), batch["key"].take(whose), batch["root"].take(whose),
                     batch["weight"].take(whose), pa.array(n[row[use][cut]], pa.int64()), pa.array(place[use][cut], pa.int64())],
                    ["shingle", "key", "root", "weight", "n", "place"])

    path = scratch_path(spark, "prefixes")
    texts.select("text", "key", "root", "weight").mapInArrow(
        run, "shingle long, key long, root long, weight long, n long, place long").write.parquet(path)
    prefixes = spark.read.parquet(path)
    early = (100 + percent) * (F.col("n") - F.col("place")) >= 2 * percent * F.col("n")
    path = scratch_path(spark, "lists")
    (prefixes.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.bool_or(early).alias("early"),
                                     F.max_by("root", F.struct("weight", "root")).alias("main"))
     .where("low != high and early").select("shingle", "main").write.parquet(path))
    listed = prefixes.join(spark.read.parquet(path), "shingle").drop("weight")
    path = scratch_path(spark, "listed")
    listed.withColumn("early", early).write.parquet(path)
    listed = spark.read.parquet(path)
    small = listed.where("early").select("shingle", *(F.col(c).alias(f"{c}_a") for c in ("key", "root", "n", "place")), "main")
    large = listed.select("shingle", *(F.col(c).alias(f"{c}_b") for c in ("key", "root", "n", "place")), F.col("main").alias("main_b"))
    left = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    near = ((F.col("root_a") != F.col("root_b")) & (F.struct("n_a", "key_a") < F.struct(F.col("n_b").alias("n_a"), F.col("key_b").alias("key_a")))
            & ((100 + percent) * left >= percent * (F.col("n_a") + F.col("n_b"))))

    def joined(x: DataFrame, y: DataFrame) -> DataFrame:
        x, y = x.drop("main").withColumnRenamed("shingle", "s"), y.drop("main_b")
        return x.join(y, (F.col("s") == F.col("shingle")) & near).select(
            F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b"))

    both = joined(small.where("root_a != main"), large).unionByName(
        joined(small.where("root_a = main"), large.where("root_b != main_b")))
    return both.groupBy("a", "b").agg(F.count("*").cast("int").alias("score"))


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest id that each linked node reaches.

    Rounds of contraction.  Every node hooks on its smallest smaller neighbour, the hooks
    are followed to their ends by doubling, and the links between different ends go to
    the next round.  Every table of a round is written to the shared folder.
    """
    spark = links.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    edges = kept(links.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct(), "links")
    labels = None
    while True:
        hooks = kept(edges.groupBy("high").agg(F.min("low").alias("to")), "hooks")
        if hooks.isEmpty():
            break
        while True:
            further = hooks.select(F.col("high").alias("to"), F.col("to").alias("beyond"))
            step = kept(hooks.join(further, "to", "left").select(
                "high", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")), "hooks")
            hooks = step.select("high", "to")
            if step.where("moved").isEmpty():
                break
        to = lambda c: hooks.select(F.col("high").alias(c), F.col("to").alias(f"{c}_to"))
        moved = (edges.join(to("high"), "high", "left").join(to("low"), "low", "left")
                 .select(F.coalesce("high_to", "high").alias("x"), F.coalesce("low_to", "low").alias("y"))
                 .where("x != y").select(F.greatest("x", "y").alias("high"), F.least("x", "y").alias("low")).distinct())
        edges = kept(moved, "links")
        named = hooks.select(F.col("high").alias("node"), F.col("to").alias("root"))
        if labels is not None:
            old = labels.join(named.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left")
            named = named.unionByName(old.select("node", F.coalesce("new", "root").alias("root")))
        labels = kept(named, "labels")
    return labels if labels is not None else hooks.select(F.col("high").alias("node"), F.col("to").alias("root"))


def find_groups(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of ``docs``.

    Documents are linked when 100 * intersection >= ``percent`` * union of their sets of
    distinct ``size``-word shingles (a shorter text is one shingle).  ``component_id`` is
    the smallest id reachable over links, ``kept`` is true for that id.  Exact copies
    of a set are one node from the start.  Rows side by side in an order are confirmed
    first and joined to components; then the orders are read again for the other
    candidates, and only those of different components come out.  The likeliest of them
    are confirmed first, the others only where they would still join two components, so
    every candidate is either confirmed, refuted or within one component.  Crowded rows,
    whose neighbours went beyond ``REACH`` in an order, then go through ``unmet``: all
    pairs of them that may still join two components are confirmed or refuted as well.

    A null or empty text has no shingles and no links.  Rows that repeat an id count as
    linked.  A null id is linked with nothing: its component is null and it is kept.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    path = scratch_path(spark, "sketches")
    sketches(rows, size).write.parquet(path)
    sets = spark.read.parquet(path)
    path = scratch_path(spark, "nodes")
    (sets.where("n > 0 and key is not null").groupBy("f1", "f2", "n")
     .agg(F.min("key").alias("key"), F.min("sketch").alias("sketch")).write.parquet(path))
    nodes = spark.read.parquet(path)
    links, number = scratch_path(spark, "links"), 0

    def kept(df: DataFrame, name: str) -> DataFrame:
        place = scratch_path(spark, name)
        df.write.parquet(place)
        return spark.read.parquet(place)

    def rooted(known: DataFrame) -> DataFrame:
        named = known.select(F.col("node").alias("key"), "root")
        return nodes.join(named, "key", "left").withColumn("root", F.coalesce("root", "key"))

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()

    def link(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """Adds the confirmed ones of the pairs (a, b) and returns the components of all links so far."""
        nonlocal number
        number += 1
        confirmed(pairs, texts, size, percent).write.parquet(f"{links}/round={number}")
        return components(spark.read.parquet(links).select("a", "b"))

    def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """Two rounds of links: the likeliest pairs of each node, then those that still join two components."""
        best = lambda c, o: F.row_number().over(Window.partitionBy(c).orderBy(F.desc("score"), o))
        first = pairs.withColumn("rank", best("a", "b")).where(F.col("rank") <= FIRST).select("a", "b").unionByName(
            pairs.withColumn("rank", best("b", "a")).where(F.col("rank") <= FIRST).select("a", "b")).distinct()
        known = link(first, texts)
        root = lambda c: known.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        rest = (pairs.join(first, ["a", "b"], "left_anti").join(root("a"), "a", "left").join(root("b"), "b", "left")
                .where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b"))
        return link(rest, texts)

    # rows side by side first: in a dense region they join most of it, and what is joined makes no more pairs
    beside = kept(candidates(nodes.withColumn("root", F.col("key")), percent, nearest=True), "beside")
    asked = kept(ends(beside), "asked")
    texts = kept(asked_for(rows, asked).distinct(), "texts")
    roots = link(beside.select("a", "b"), texts)
    met = kept(candidates(rooted(roots), percent).join(beside.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    more_asked = kept(ends(met).join(asked, "key", "left_anti"), "asked")
    texts = texts.unionByName(kept(asked_for(rows, more_asked).distinct(), "texts"))
    roots = confirm(met.where("a != b"), texts)
    crowd = (met.where("a = b").select(F.col("a").alias("key"))
             .join(roots.select(F.col("node").alias("key"), "root"), "key", "left")
             .select("key", F.coalesce("root", "key").alias("root")))
    path = scratch_path(spark, "crowd")
    crowd.join(crowd.groupBy("root").agg(F.count("*").alias("weight")), "root").write.parquet(path)
    crowd = spark.read.parquet(path)
    if not crowd.isEmpty():
        path = scratch_path(spark, "unmet")
        unmet(texts.join(crowd, "key"), size, percent).write.parquet(path)
        more = spark.read.parquet(path)
        if not more.isEmpty():
            roots = confirm(more, texts)
    same = nodes.select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("n").alias("m"), F.col("key").alias("node"))
    found = (sets.select("key", "n", "f1", "f2")
             .join(same, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n") == F.col("m"))
                   & F.col("key").isNotNull(), "left")
             .select("key", "n", F.coalesce("node", "key").alias("node")).join(roots, "node", "left"))
    component = F.coalesce("root", "node")
    return found.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
                        F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all columns.

    Of rows that share an id and a text one stays; rows that share an id but not the text
    are different documents, and each text stays if its id is kept.  Rows without an id
    stay.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "groups")
    find_groups(docs, size, percent, key, text).write.parquet(path)
    found = spark.read.parquet(path)
    # written, so that its size is known when the join is planned and a small one moves no text
    path = scratch_path(spark, "left-out")
    found.where("not kept").select(F.col(key).alias("__id")).distinct().write.parquet(path)
    left_out = spark.read.parquet(path)
    stays = docs.join(left_out, docs[key] == left_out["__id"], "left_anti")
    again = found.where(F.col(key).isNotNull() & F.col("kept")).groupBy(F.col(key).alias("__id")).count().where("count > 1")
    if again.isEmpty():
        return stays
    once = stays.join(again, stays[key] == again["__id"], "left_semi").dropDuplicates([key, text])
    return stays.join(again, stays[key] == again["__id"], "left_anti").unionByName(once)
