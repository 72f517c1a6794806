"""Quality rules for documents and for the hosts they come from.

Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.secret_scan import let
from wardlight.session import scratch_path

_SPACE = " \t\n\x0b\f\r"
_SIGNS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50
#: A host whose shrunken failure rate is above this is rejected as a whole.
HOST_LIMIT = 0.6


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that the text holds twice or more.

    Windows are compared by a 64-bit hash.  Only if some hash repeats are (hash, place)
    sorted; places of repeated hashes then count for three words each, overlaps once.
    """
    def cover(places: Column) -> Column:
        def step(acc: Column, p: Column) -> Column:
            return F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last"))
        first = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(places, first, step)["n"]

    def places(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda x, i, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            again = F.filter(s, lambda x, i: same(x, i, i - 1) | same(x, i, i + 1))
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        return let(pairs, twice)

    def counted(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                             lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(hashes, lambda h: F.when(
            F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(cover(places(h)))))

    return let(words, counted)


def measures(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """``keep`` columns and the numbers that the rules read, a row for each row of ``docs``."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    without = lambda signs: F.length(t) - F.length(F.translate(t, signs, ""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, _SPACE, "")) > 0)
    both = let(words_of(t), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("again")))
    rows = docs.select(
        *keep, both.alias("__w"), F.length(F.translate(t, _SPACE, "")).alias("word_chars"),
        without(_SIGNS).alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))
    long = lambda c: F.col(c).cast("long")
    return rows.select(
        *keep, long("__w.n").alias("n_words"), long("word_chars").alias("word_chars"),
        long("n_symbols").alias("n_symbols"), long("n_dup_lines").alias("n_dup_lines"),
        long("__w.again").alias("n_repeat_words"))


def failed() -> Column:
    n = F.col("n_words")
    return (n < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * n)


def host_verdicts(judged: DataFrame, host: str, limit: float = HOST_LIMIT) -> DataFrame:
    """(host, n, fails, rate, rejected): failure rates drawn towards the corpus.

    The prior Beta(a, b) is fitted to all hosts by moments: mean m of the rates weighted
    by documents, strength a + b from their variance beyond what binomial draws give.
    ``rate`` is (fails + a) / (n + a + b), so a host with few documents is near m.
    ``judged`` has a boolean ``base_failed``; it is summed in each task before the
    shuffle.  A null host is a host of its own.
    """
    hosts = judged.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("fails"))
    total = hosts.agg(
        F.sum("n").cast("double").alias("n"), F.sum("fails").cast("double").alias("f"),
        F.count("*").cast("double").alias("k"), F.sum(F.col("n") * F.col("n").cast("double")).alias("nn"),
        F.sum(F.col("fails") * F.col("fails").cast("double") / F.col("n")).alias("ff"))
    m = F.col("f") / F.col("n")
    between = F.col("ff") - F.col("n") * m * m
    inside = (F.col("k") - 1) * m * (1 - m)
    scale = F.col("n") - F.col("nn") / F.col("n")
    rho = F.when((scale > 0) & (m > 0) & (m < 1), F.least(F.lit(0.99), F.greatest(
        F.lit(1e-4), (between - inside) / (scale * m * (1 - m))))).otherwise(F.lit(0.5))
    prior = total.select((m * (1 - rho) / rho).alias("a"), ((1 - m) * (1 - rho) / rho).alias("b")).first()
    a, b = (prior["a"], prior["b"]) if prior["a"] is not None else (1.0, 1.0)
    rate = (F.col("fails") + F.lit(a)) / (F.col("n") + F.lit(a + b))
    return hosts.select("host", "n", "fails", rate.alias("rate"), (rate > limit).alias("rejected"))


def apply_rules(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT, key: str = "doc_id",
                text: str = "text") -> DataFrame:
    """(key, measures, base_failed, host_rate, kept) for each row of ``docs``.

    A document is kept if it passes the rules itself and its host isn't rejected.  The
    measures are written once, without texts; host verdicts are joined back to them.

    Null and empty texts have no words and fail; a null key stays null; repeated rows
    repeat; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "measures")
    rows = measures(docs.select(F.col(key).alias("__key"), F.col(host).cast("string").alias("__host"),
                                F.col(text).cast("string").alias("text")), "__key", "__host")
    rows.withColumn("base_failed", failed()).write.parquet(path)
    judged = spark.read.parquet(path)
    path = scratch_path(spark, "hosts")
    host_verdicts(judged, "__host", limit).write.parquet(path)
    hosts = spark.read.parquet(path)
    return (judged.join(hosts.select("host", "rate", "rejected"), F.col("__host").eqNullSafe(F.col("host")), "left")
            .select(F.col("__key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", F.col("rate").alias("host_rate"),
                    (~F.col("base_failed") & ~F.col("rejected")).alias("kept")))


def keep_good(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``apply_rules`` keeps, with all their columns.

    The rules are evaluated on the texts where they lie, once for the hosts' rates and
    once for the filter, so no text is moved; hosts that are rejected are removed by an
    anti-join.
    """
    spark = docs.sparkSession
    t = F.col(text).cast("string")
    numbers = let(words_of(F.coalesce(t, F.lit(""))), lambda w: F.struct(
        F.size(w).alias("n"), repeated_words(w).alias("again")))
    bad = let(numbers, lambda x: (x["n"] < LEAST_WORDS) | (100 * x["again"] > MOST_REPEATED * x["n"]))
    path = scratch_path(spark, "hosts")
    host_verdicts(docs.select(F.col(host).cast("string").alias("__host"), bad.alias("base_failed")), "__host", limit
                  ).where("rejected").select(F.col("host").alias("__host")).write.parquet(path)
    rejected = spark.read.parquet(path)
    good = docs.where(~bad)
    return good.join(rejected, good[host].cast("string").eqNullSafe(rejected["__host"]), "left_anti")
