"""Phrases of two and three words that stand together, mined best first over prefix counts, by language."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.llm.words import sliced, spread, text_bytes, unit_hashes
from wardlight.session import scratch_path

LEAST = 10
TOP = 2000
#: Per cent of a candidate's count from which a longer one that holds it takes its place.
PERCENT = 50
SCALE = 1_000_000
#: Bytes of text, and words of them, that a task turns at once.
SLICE, SECTION_WORDS = 2 << 20, 300_000
#: Bits of a broadcast filter whatever the input, and bits a row of it.
FILTER_BITS, ROW_BITS = 1 << 26, 1 << 15
#: The first wave's bound is about the score of the candidate at TOP * FIRST_WAVE, each next one's at NEXT_WAVE times that place.
FIRST_WAVE, NEXT_WAVE = 2, 4
#: Steps of a doubling of the score, in which a bound is sought.
STEPS = 8
NO_LANGUAGE = "und"

_BLANK, _BREAK = 32, 10
_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[65:91] += 32
_TABLE[9] = _BLANK
_TABLE[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = _BREAK
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FURTHER = np.uint64(0xD6E8FEB86659FD93)


class Section(NamedTuple):
    """Words of one stretch of text; the first ``own`` of them start the phrases counted here.

    ``word`` numbers the distinct (language, word) of ``lang`` and ``text``; ``hashes`` and
    ``spoken`` are theirs; ``joined`` says whether a word and the next one are in one piece.
    """

    own: int
    word: np.ndarray
    joined: np.ndarray
    lang: pa.Array
    text: pa.Array
    hashes: np.ndarray
    spoken: np.ndarray


def _spoken(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "big")


def _place(spoken: np.ndarray, *hashes: np.ndarray) -> np.ndarray:
    """A place in a filter for a phrase of a language."""
    out = spoken
    for h in hashes:
        out = (out ^ h) * _MIX
        out = (out ^ (out >> np.uint64(29))) * _FURTHER
    return (out >> np.uint64(64 - (FILTER_BITS - 1).bit_length())).astype(np.int64)


def sections(batches: Iterable[pa.RecordBatch]) -> Iterator[Section]:
    """The words of (lang, text) batches, ``SECTION_WORDS`` at a time and two more that phrases may end in."""
    for batch in sliced(batches, most=SLICE):
        raw, ends = text_bytes(batch["text"])
        data = _TABLE[raw]
        inside = (data != _BLANK) & (data != _BREAK)
        edge = np.zeros(len(data) + 1, bool)
        edge[ends] = True
        opens = inside.copy()
        opens[1:] &= ~inside[:-1] | edge[1:-1]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | edge[1:-1]
        start = np.flatnonzero(opens)
        length = np.flatnonzero(closes) + 1 - start
        row = np.searchsorted(ends, start, side="right") - 1
        piece = np.searchsorted(np.flatnonzero(data == _BREAK), start)
        joined = np.append((row[1:] == row[:-1]) & (piece[1:] == piece[:-1]), [False])[:len(start)]
        langs = pc.fill_null(batch["lang"], NO_LANGUAGE).dictionary_encode()
        code = langs.indices.to_numpy()[row].astype(np.uint64)
        spoken = np.array([_spoken(x) for x in langs.dictionary.to_pylist()], np.uint64)
        for at in range(0, len(start), SECTION_WORDS):
            upto = min(at + SECTION_WORDS + 2, len(start))
            low, high = start[at], start[upto - 1] + length[upto - 1]
            hashes = unit_hashes(data[low:high], inside[low:high], start[at:upto] - low, length[at:upto])
            tongue = code[at:upto]
            _, first, word = np.unique((hashes ^ (tongue * _FURTHER)) * _MIX, return_index=True, return_inverse=True)
            body = data[spread(start[at + first], length[at + first])]
            offsets = np.append(0, np.cumsum(length[at + first])).astype(np.int32)
            text = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(body))
            kinds = tongue[first].astype(np.int64)
            yield Section(min(SECTION_WORDS, upto - at), word, joined[at:upto], langs.dictionary.take(pa.array(kinds)), text,
                          hashes[first], spoken[kinds])


def _counted(docs: DataFrame, phrases: Callable[[Section], np.ndarray]) -> DataFrame:
    """(lang, phrase, a): how often the phrases of ``phrases`` (word numbers, a row each) occur in all of ``docs``.

    A section's occurrences are counted in the task, Spark adds them up before and after the shuffle.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in sections(batches):
            found = phrases(s)
            if not len(found):
                continue
            rank = found[:, 0]
            for column in found.T[1:]:  # the phrases so far are numbered anew, so that the numbers stay small
                _, rank = np.unique(rank * len(s.text) + column, return_inverse=True)
            _, first, n = np.unique(rank, return_index=True, return_counts=True)
            distinct = found[first]
            for low in range(0, len(distinct), 50_000):
                part, many = distinct[low:low + 50_000], n[low:low + 50_000]
                words = [s.text.take(pa.array(column)) for column in part.T]
                phrase = words[0] if len(words) == 1 else pc.binary_join_element_wise(*words, " ")
                yield pa.RecordBatch.from_arrays(
                    [s.lang.take(pa.array(part[:, 0])), phrase, pa.array(many, pa.int64())], ["lang", "phrase", "a"])

    return docs.mapInArrow(run, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _bitmap(phrases: DataFrame, words: int) -> Broadcast:
    """A filter of ``phrases`` (lang, phrase) of so many words, as large as ``FILTER_BITS`` whatever the input."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "phrase", SLICE):
            data, ends = text_bytes(batch["phrase"])
            inside = data != _BLANK
            opens = inside.copy()
            opens[1:] &= ~inside[:-1]
            opens[ends[:-1]] = True
            start = np.flatnonzero(opens)
            word = np.cumsum(opens)[inside] - 1
            hashes = unit_hashes(data, inside, start, np.bincount(word, minlength=len(start))).reshape(-1, words)
            langs = batch["lang"].dictionary_encode()
            spoken = np.array([_spoken(x) for x in langs.dictionary.to_pylist()], np.uint64)[langs.indices.to_numpy()]
            place = np.unique(_place(spoken, *hashes.T))
            yield pa.RecordBatch.from_arrays([pa.array(place // ROW_BITS), pa.array(place % ROW_BITS)], ["row", "bit"])

    out = np.zeros((FILTER_BITS // ROW_BITS, ROW_BITS // 8), np.uint8)
    rows = phrases.select("lang", "phrase").mapInArrow(run, "row long, bit long").groupBy("row").agg(
        F.bitmap_construct_agg("bit").alias("bits"))
    for r in rows.collect():  # FILTER_BITS in all
        out[r["row"]] = np.frombuffer(r["bits"], np.uint8)
    return phrases.sparkSession.sparkContext.broadcast(out.ravel())


def _among(bitmap: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bitmap[place >> 3] >> (place & 7) & 1).astype(bool)


def _exact(c: Column) -> Column:
    return c.cast("decimal(14,0)")


def _ratio(over: Column, *under: Column) -> Column:
    """floor(SCALE * over / product of under) for exact integers beyond 64 bits."""
    below = _exact(under[0]) if len(under) == 1 else _exact(under[0]) * _exact(under[1])
    return F.call_function("div", over * F.lit(SCALE).cast("decimal(7,0)"), below)


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    return _ratio(_exact(a) * _exact(a), l, r)


def _pairs(docs: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """Two-word candidates (lang, phrase, a, l, r, score); both words are frequent, so others aren't counted at all."""
    frequent = _bitmap(words, 1)

    def twos(s: Section) -> np.ndarray:
        known = _among(frequent.value, _place(s.spoken, s.hashes))[s.word]
        at = np.flatnonzero(s.joined & known & np.append(known[1:], False))
        at = at[at < s.own]
        return np.stack([s.word[at], s.word[at + 1]], 1)

    many = _written(_counted(docs, twos).where(F.col("a") >= least), "pairs")
    f = lambda c, n: words.select("lang", F.col("phrase").alias(c), F.col("a").alias(n))
    split = many.withColumn("w1", F.split_part("phrase", F.lit(" "), F.lit(1))).withColumn("w2", F.split_part("phrase", F.lit(" "), F.lit(2)))
    scored = split.join(f("w1", "l"), ["lang", "w1"]).join(f("w2", "r"), ["lang", "w2"])
    return _written(scored.select("lang", "phrase", "w1", "w2", "a", "l", "r", _score(F.col("a"), F.col("l"), F.col("r")).alias("score")),
                    "scored-pairs")


def _triples(docs: DataFrame, pairs: DataFrame, words: DataFrame, frontier: DataFrame, least: int) -> DataFrame:
    """Three-word candidates (lang, phrase, a, l, r, score, head, tail) that may reach their language's bound.

    A phrase's count is at most that of the two words it starts with, so its score is at
    most SCALE * that count / the first word's count; the same holds from its end.  Only
    phrases whose both ends leave room for the bound of ``frontier`` (lang, bound) grow,
    and those that hold a two-word candidate at the bound, which they might replace.
    """
    here = pairs.join(frontier, "lang")
    bound = F.col("bound")
    every, reached = _bitmap(here, 2), _bitmap(here.where(F.col("score") >= bound), 2)
    a = F.col("a").cast("decimal(26,0)")
    heads, tails = (_bitmap(here.where(_ratio(a, F.col(c)) >= bound), 2) for c in ("l", "r"))

    def threes(s: Section) -> np.ndarray:
        at = np.flatnonzero(s.joined[:-2] & s.joined[1:-1]) if len(s.word) > 2 else np.zeros(0, np.int64)
        at = at[at < s.own]
        w = [s.word[at + k] for k in range(3)]
        spoken = s.spoken[w[0]]
        head, tail = _place(spoken, s.hashes[w[0]], s.hashes[w[1]]), _place(spoken, s.hashes[w[1]], s.hashes[w[2]])
        use = (_among(every.value, head) & _among(every.value, tail)
               & (_among(reached.value, head) | _among(reached.value, tail)
                  | _among(heads.value, head) & _among(tails.value, tail)))
        return np.stack(w, 1)[use]

    many = _written(_counted(docs, threes).where(F.col("a") >= least), "triples")
    word = lambda i: F.split_part("phrase", F.lit(" "), F.lit(i))
    split = many.select("lang", "phrase", "a", word(1).alias("w1"), word(3).alias("w3"), F.concat_ws(" ", word(1), word(2)).alias("head"),
                        F.concat_ws(" ", word(2), word(3)).alias("tail"))
    f = lambda of, c: of.select("lang", F.col("phrase").alias(c), F.col("a").alias(f"f_{c}"))
    joined = (split.join(f(here, "head"), ["lang", "head"]).join(f(here, "tail"), ["lang", "tail"])
              .join(f(words, "w1"), ["lang", "w1"]).join(f(words, "w3"), ["lang", "w3"]))
    cut = F.least(*(F.struct(_score(F.col("a"), F.col(x), F.col(y)).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r"))
                    for k, x, y in ((1, "f_w1", "f_tail"), (2, "f_head", "f_w3"))))
    return _written(joined.select("lang", "phrase", "a", "head", "tail", cut.alias("cut")).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "cut.score", "head", "tail"), "scored-triples")


def _survivors(pairs: DataFrame, triples: DataFrame, frontier: DataFrame, percent: int) -> DataFrame:
    """All candidates at their language's bound that no longer one replaces: (lang, phrase, a, l, r, score, bound)."""
    kept = ["lang", "phrase", "a", "l", "r", "score"]
    reached = pairs.join(frontier, "lang").where(F.col("score") >= F.col("bound"))
    larger = triples.select("lang", F.explode(F.array("head", "tail")).alias("phrase"), F.col("a").alias("longer")).groupBy(
        "lang", "phrase").agg(F.max("longer").alias("longer"))
    held = (100 * _exact(F.col("longer")) >= percent * _exact(F.col("a")))
    twos = reached.join(larger, ["lang", "phrase"], "left").where(~F.coalesce(held, F.lit(False))).select(*kept, "bound")
    threes = triples.join(frontier, "lang").where(F.col("score") >= F.col("bound")).select(*kept, "bound")
    return twos.unionByName(threes)


def _frontier(pairs: DataFrame, place: int) -> DataFrame:
    """(lang, bound): a score that at least ``place`` of a language's pairs reach, 0 where there are fewer.

    From counts by step of the score, ``STEPS`` to a doubling, so that no task sorts a language.
    """
    step = F.floor(F.log2(F.col("score") + 1) * STEPS)
    down = Window.partitionBy("lang").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = pairs.groupBy("lang", step.alias("step")).agg(F.count("*").alias("many"), F.min("score").alias("bound"))
    summed = reached.withColumn("upto", F.sum("many").over(down))
    return summed.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("upto") >= place, F.col("bound"))), F.lit(0)).alias("bound"))


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(order))


def mine(docs: DataFrame, top: int = TOP, least: int = LEAST, percent: int = PERCENT, text: str = "text",
         lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best ``top`` phrases of two or three words.

    A-Z count as a-z; ``.,;:!?`` and line ends part pieces, blanks and tabs words.  A
    phrase's score is that of its worst cut, floor(10^6 a a / (l r)), exact; phrases of
    fewer than ``least`` occurrences are no candidates, and those that stand in a longer
    candidate with ``percent`` per cent of their occurrences are dropped.

    The frontier is grown best first.  Words are counted, then pairs of frequent words;
    a pair's counts bound the scores of all phrases it starts or ends.  Each wave grows
    the pairs whose bound reaches about the score at some place of the language's list.  The
    language is settled when ``top`` candidates at that score survive: whatever wasn't
    grown scores less.  Otherwise the next wave goes on for it with a lower bound, in
    the end with none.

    A null text has no words, a null language is ``und``, repeated rows count again.
    A language with fewer candidates returns all of them, none at all no row.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text).cast("string").alias("text"))
    counts = _written(_counted(rows, lambda s: s.word[:s.own, None]), "words")
    total = counts.groupBy("lang").agg(F.sum("a").alias("n"))
    words = _written(counts.where(F.col("a") >= least), "frequent")
    pairs = _pairs(rows, words, least)
    out, wave = scratch_path(spark, "phrases"), 0
    open_ = _written(pairs.select("lang").distinct(), "languages")
    while wave == 0 or not open_.isEmpty():
        frontier = _written(_frontier(pairs.join(open_, "lang"), top * FIRST_WAVE * NEXT_WAVE**wave), "frontier")
        triples = _triples(rows, pairs, words, frontier, least)
        found = _written(_survivors(pairs, triples, frontier, percent), "survivors")
        enough = found.groupBy("lang", "bound").agg(F.count("*").alias("many"))
        done = _written(frontier.join(enough, ["lang", "bound"], "left").where((F.col("bound") == 0) | (F.col("many") >= top)).select("lang"), "settled")
        _ranked(found.join(done, "lang")).where(F.col("rank") <= top).drop("bound").write.parquet(f"{out}/wave={wave}")
        open_ = _written(open_.join(done, "lang", "left_anti"), "languages")
        wave += 1
    best = spark.read.parquet(out)
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
