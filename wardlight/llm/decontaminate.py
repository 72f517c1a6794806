"""Benchmark passages in training text, found through a positional inverted index."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.words import ALNUM, sliced, words
from wardlight.session import scratch_path

WINDOW = 10
BLOCK_BYTES = 4 << 20
#: Text whose words a task holds at once; they take some twenty times as much.
SLICE = 1 << 20


class Phrases:
    """The windows of a block of benchmark items over the block's own terms."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        found = words(pa.array([t for _, t in items], pa.string()), ALNUM)
        self.terms, code = np.unique(found.hashes, return_inverse=True)
        seen: dict[tuple[int, ...], set[str]] = {}
        end = 0
        for (item, _), n in zip(items, found.per_row.tolist(), strict=True):
            own = code[end:end + n].tolist()
            end += n
            for i in range(max(1, n - window + 1) if n else 0):
                seen.setdefault(tuple(own[i:i + window]), set()).add(item)
        self.windows = list(seen)
        self.items = [sorted(seen[w]) for w in self.windows]

    def by_rarest(self, frequency: dict[int, int]) -> dict[int, list[tuple[int, list[tuple[int, int]]]]]:
        """rarest term -> [(window, [(term, offset) from the rarest term on])]."""
        out: dict[int, list] = {}
        for k, terms in enumerate(self.windows):
            order = sorted(zip(terms, range(len(terms)), strict=True), key=lambda x: (frequency.get(x[0], 0), x))
            if frequency.get(order[0][0], 0):
                out.setdefault(order[0][0], []).append((k, order))
        return out


def postings(docs: DataFrame, phrases: Phrases) -> DataFrame:
    """The index: per row of (key, text), its words' number and the positions of each term.

    ``terms`` are the block's term numbers that occur, ``counts`` their occurrences,
    ``positions`` the ascending positions of the first term, then of the second, ...
    The index is split by documents, so a term that is in every document is spread over
    all tasks; terms that no benchmark item holds can't match and aren't stored.
    """
    given = docs.sparkSession.sparkContext.broadcast(phrases.terms)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = given.value
        likely = np.zeros(1 << 16, bool)
        likely[(terms >> np.uint64(48)).astype(np.int64)] = True
        for batch in sliced(batches, most=SLICE):
            found = words(batch["text"], ALNUM)
            at = np.flatnonzero(likely[(found.hashes >> np.uint64(48)).astype(np.int64)])
            code = np.searchsorted(terms, found.hashes[at])
            hit = terms[np.minimum(code, len(terms) - 1)] == found.hashes[at] if len(terms) else code < 0
            at, code = at[hit], code[hit]
            first = np.cumsum(found.per_row) - found.per_row
            row = np.searchsorted(first, at, side="right") - 1
            # an empty row begins where the next one does: the last row that begins there has the word
            order = np.lexsort((at, code, row))
            at, code, row = at[order], code[order], row[order]
            opens = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (row[1:] != row[:-1])]) if len(at) else at
            counts = np.diff(np.r_[opens, len(at)])
            upto = np.arange(batch.num_rows + 1)
            by_term = pa.array(np.searchsorted(row[opens], upto), pa.int32())
            by_word = pa.array(np.searchsorted(row, upto), pa.int32())
            ints = lambda x: pa.array(x, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch["key"], pa.array(found.per_row, pa.int64()),
                 pa.ListArray.from_arrays(by_term, ints(code[opens])),
                 pa.ListArray.from_arrays(by_term, ints(counts)),
                 pa.ListArray.from_arrays(by_word, ints(at - first[row]))],
                ["key", "n_words", "terms", "counts", "positions"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"key {kind}, n_words long, terms array<int>, counts array<int>, positions array<int>")


def phrase_starts(lists: dict[int, list[int]], order: list[tuple[int, int]]) -> list[int]:
    """Places where the phrase begins: offset-adjusted lists intersected from the rarest on."""
    term, offset = order[0]
    starts = [p - offset for p in lists[term]]
    for term, offset in order[1:]:
        own = lists.get(term)
        if own is None or not starts:
            return []
        kept = []
        for s in starts:
            i = bisect_left(own, s + offset)
            if i < len(own) and own[i] == s + offset:
                kept.append(s)
        starts = kept
    return starts


def is_near(lists: dict[int, list[int]], order: list[tuple[int, int]], span: int) -> bool:
    """Whether some ``span`` consecutive words hold every term of the phrase, in any order."""
    need = {t for t, _ in order}
    if not need <= lists.keys():
        return False
    for p in lists[order[0][0]]:
        around = []
        for t in need:
            own = lists[t]
            i = bisect_left(own, p - span + 1)
            some = False
            while i < len(own) and own[i] < p + span:
                around.append((own[i], t))
                some = True
                i += 1
            if not some:
                break
        else:
            around.sort()
            last: dict[int, int] = {}
            for q, t in around:
                last[t] = q
                if len(last) == len(need) and q - min(last.values()) < span:
                    return True
    return False


def matches(index: DataFrame, phrases: Phrases, slack: int) -> DataFrame:
    """Per index row: the word positions hit, and the items matched exactly and nearly."""
    spark = index.sparkSession
    counted = (index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x"))
               .groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("n")).collect())
    given = spark.sparkContext.broadcast(
        (phrases.by_rarest({r["term"]: r["n"] for r in counted}), phrases.items, len(phrases.terms)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarest, items, n_terms = given.value
        starts_one = np.zeros(n_terms, bool)
        starts_one[list(rarest)] = True
        for batch in batches:
            n = batch.num_rows
            terms = batch["terms"].flatten().to_numpy(zero_copy_only=False)
            per_row = np.diff(batch["terms"].offsets.to_numpy())
            rows = np.repeat(np.arange(n), per_row)[starts_one[terms]] if len(terms) else terms
            hits: list[list[int]] = [[] for _ in range(n)]
            exact: list[list[str]] = [[] for _ in range(n)]
            near: list[list[str]] = [[] for _ in range(n)]
            for i in np.unique(rows).tolist():
                own, counts = batch["terms"][i].as_py(), batch["counts"][i].as_py()
                positions = batch["positions"][i].as_py()
                lists, at = {}, 0
                for t, c in zip(own, counts, strict=True):
                    lists[t] = positions[at:at + c]
                    at += c
                hit, whole, close = set(), set(), set()
                for t in own:
                    for k, order in rarest.get(t, ()):
                        for s in phrase_starts(lists, order):
                            hit.update(range(s, s + len(order)))
                            whole.update(items[k])
                        if not close.issuperset(items[k]) and is_near(lists, order, len(order) + slack):
                            close.update(items[k])
                hits[i], exact[i], near[i] = sorted(hit), sorted(whole), sorted(close)
            yield pa.RecordBatch.from_arrays(
                [batch["key"], batch["n_words"], pa.array(hits, pa.list_(pa.int32())),
                 pa.array(exact, pa.list_(pa.string())), pa.array(near, pa.list_(pa.string()))],
                ["key", "n_words", "hits", "items", "near_items"])

    kind = index.schema["key"].dataType.simpleString()
    return index.mapInArrow(
        run, f"key {kind}, n_words long, hits array<int>, items array<string>, near_items array<string>")


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int = 5,
                  key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row (key, n_words, hits, items, near_items) for each row of ``docs``.

    ``hits`` are the positions of words inside an occurrence of ``window`` consecutive
    words of an item (an item of fewer words is one window), ``items`` those items;
    ``near_items`` have all terms of a window within ``slack`` words more than it is
    long, in any order.

    Postings of the training words are written once to the shared folder; term
    frequencies and all matching come from there.  The benchmark is taken in blocks
    of about ``block_bytes`` of text, the only thing sent to tasks; with several
    blocks each row's findings are put together by a row number.

    Null or empty texts have no words and no findings; items without words match
    nothing; a null item id counts as "".  Repeated rows and items give repeated rows
    and one item; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"),
                             F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)

    def found(own: DataFrame, block: int) -> DataFrame:
        part = items if blocks < 2 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        phrases = Phrases([(r["item"], r["text"]) for r in part.collect()], window)
        path = scratch_path(spark, "postings")
        postings(own, phrases).write.parquet(path)
        return matches(spark.read.parquet(path), phrases, slack)

    if blocks < 2:
        return found(rows, 0).withColumnRenamed("key", key)
    path = scratch_path(spark, "numbered")
    rows.select(F.struct("key", F.monotonically_increasing_id().alias("row")).alias("key"), "text").write.parquet(path)
    numbered = spark.read.parquet(path)
    parts = [found(numbered, b) for b in range(blocks)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return (every.groupBy("key").agg(F.first("n_words").alias("n_words"), merged("hits"), merged("items"),
                                     merged("near_items"))
            .select(F.col("key.key").alias(key), "n_words", "hits", "items", "near_items"))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and a digest of the findings of ``find_passages``."""
    return found.select(
        key, "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near_items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any word inside a benchmark window, all columns kept.

    Rows are told apart by key and a hash of the text, so rows that share a key are
    judged each by its own text.
    """
    mark = F.struct(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("h"))
    found = find_passages(docs.select(mark.alias("key"), F.col(text).alias("text")), benchmark, key="key")
    # written, so that its size is known when the join is planned and a small one moves no text
    path = scratch_path(docs.sparkSession, "contaminated")
    found.where(F.size("hits") > 0).select(
        F.col("key.id").alias("__id"), F.col("key.h").alias("__h")).write.parquet(path)
    bad = docs.sparkSession.read.parquet(path)
    return docs.join(bad, docs[key].eqNullSafe(bad["__id"]) & (F.xxhash64(docs[text]) == bad["__h"]), "left_anti")
