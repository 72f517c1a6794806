"""Distance from a name to the popular names it may imitate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from wardlight.functions.text import constant_words
from wardlight.operators.bounds import LITERAL_ROWS, literal_values
from wardlight.session import checkpoint

EMPTY_DISTANCE = 99
CANDIDATE_DISTANCE = 2
#: Lengths of the grams that names are compared by, the most selective first.
GRAMS = (3, 2)
#: Names of one length that are compared with a name in one row.
LIST_NAMES = 1_000


def least_distance(sld: Column, names: Column) -> Column:
    """Smallest edit distance over an array, at most 99; 99 for an empty name.

    Skipping names by length or running best costs more than it saves here:
    measured on a million names, the plain minimum is the fastest form.
    """
    d = F.array_min(F.transform(names, lambda n: F.levenshtein(sld, n)))
    return F.when(sld == "", EMPTY_DISTANCE).otherwise(F.least(F.lit(EMPTY_DISTANCE), d))


def nearest_name(sld: Column, names: Column) -> Column:
    """Struct (d, n): smallest distance and its name, alphabetical on ties."""
    best = F.array_min(F.transform(names, lambda n: F.struct(F.levenshtein(sld, n).alias("d"), n.alias("n"))))
    none = F.struct(F.lit(EMPTY_DISTANCE).alias("d"), F.lit(None).cast("string").alias("n"))
    return F.when((sld == "") | best.isNull() | (best["d"] >= EMPTY_DISTANCE), none).otherwise(best)


def names_literal(names: list[str]) -> Column:
    return constant_words(sorted(set(names)))


def nearest_popular(df: DataFrame, popular: DataFrame, sld_col: str = "sld",
                    literal_limit: int = LITERAL_ROWS) -> DataFrame:
    """Adds exact ``typosquat_distance`` and ``similar_domain``.

    The comparison runs once per distinct name, so a name held by a third of
    the rows costs one comparison; exact hits are settled by an equi-join.
    A popular list within ``literal_limit`` becomes an array in the plan; for a
    longer one names are compared only with those that share grams with them.
    """
    slds = df.select(F.col(sld_col).alias("_s")).where(F.col("_s").isNotNull()).distinct()
    pop = popular.select(F.col("name").alias("_p")).where(F.col("_p") != "").distinct()
    hits = slds.join(pop, F.col("_s") == F.col("_p"), "left")
    exact = hits.where(F.col("_p").isNotNull()).select(
        "_s", F.lit(0).alias("typosquat_distance"), F.col("_p").alias("similar_domain"))
    rest = hits.where(F.col("_p").isNull()).select("_s")
    values = literal_values(pop, "_p", literal_limit)
    if values is not None:
        scored = rest.withColumn("_m", nearest_name(F.col("_s"), names_literal(values)))
    else:
        scored = _by_grams(rest, pop)
    near = scored.select("_s", F.col("_m.d").alias("typosquat_distance"),
                         F.col("_m.n").alias("similar_domain"))
    # One row per distinct name: this side never outgrows the other, and AQE
    # splits the other side where one name dominates.
    return df.join(exact.unionByName(near), F.col(sld_col) == F.col("_s"), "left").drop("_s")


def grams(word: Column, size: int) -> Column:
    """The word's distinct grams: each with its length and the number of equal ones up to it.

    Two words at distance d share at least max(n, m) + size - 1 - size * d of them.
    """
    padded = F.concat(F.lit("\u0001" * (size - 1)), word, F.lit("\u0002" * (size - 1)))
    found = F.transform(F.sequence(F.lit(1), F.length(word) + (size - 1)), lambda i: F.substring(padded, i, F.lit(size)))
    return F.transform(found, lambda g, i: F.concat_ws(
        "#", F.lit(size), g, F.size(F.filter(F.slice(found, F.lit(1), i + 1), lambda x: x == g))))


def gram_candidates(slds: DataFrame, pop: DataFrame, size: int) -> DataFrame:
    """(_s, _n, _best, _p): the names ``_p`` (of ``pop``) to compare each of ``slds`` (_s, _n, _best) with.

    ``_best`` (d, n) is the best name known.  All names at a distance of at most
    ``_best.d`` that share a gram are among them: such a name shares one of the word's
    ``size * _best.d + 1`` rarest grams, and its length differs by no more than that.
    Names are left out whose length alone rules out a distance at which sharing is sure.
    """
    index = pop.select("_p", F.length("_p").alias("_m"), F.explode(grams(F.col("_p"), size)).alias("_g"))
    frequency = index.groupBy("_g").agg(F.count("*").alias("_f"))
    probes = slds.withColumn("_g", F.explode(grams(F.col("_s"), size))).join(frequency, "_g", "left")
    rarest = Window.partitionBy("_s").orderBy(F.coalesce("_f", F.lit(0)), "_g")
    sure = F.col("_n") + (size - 1) - size * F.col("_best.d") >= 1
    used = (probes.withColumn("_rank", F.row_number().over(rarest))
            .where(F.col("_f").isNotNull() & (~sure | (F.col("_rank") <= size * F.col("_best.d") + 1))))
    reach = F.least(F.col("_best.d"), F.floor((F.col("_n") + (size - 2)) / size))
    return (used.select("_s", "_n", "_best", "_g").join(index, "_g")
            .where(F.abs(F.col("_n") - F.col("_m")) <= reach).select("_s", "_n", "_best", "_p"))


def length_candidates(slds: DataFrame, pop: DataFrame) -> DataFrame:
    """(_s, _best, _names): the names whose length allows the distance ``_best.d``, in lists of one length."""
    at = F.pmod(F.xxhash64("_p"), F.col("_lists"))
    sizes = pop.groupBy(F.length("_p").alias("_m")).agg(F.ceil(F.count("*") / LIST_NAMES).alias("_lists"))
    lists = (pop.withColumn("_m", F.length("_p")).join(sizes, "_m").groupBy("_m", at.alias("_list"))
             .agg(F.array_sort(F.collect_list("_p")).alias("_names")))
    lengths = F.sequence(F.greatest(F.lit(1), F.col("_n") - F.col("_best.d")), F.col("_n") + F.col("_best.d"))
    asked = (slds.withColumn("_m", F.explode(lengths)).join(sizes, "_m")
             .withColumn("_list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_lists") - 1))))
    return asked.join(lists, ["_m", "_list"]).select("_s", "_best", "_names")


def _by_grams(rest: DataFrame, pop: DataFrame) -> DataFrame:
    """(_s, _m): the nearest name of a long list, exact, without comparing all pairs.

    A name's distance to a word it shares no character with is the longer one's length,
    so the first name of each length is a bound to start from.  Then the grams of each
    size, longest first, lead to better names.  A word whose best distance d leaves no
    room for a name that shares no gram (n + size - 1 - size * d >= 1) is settled; only
    the others go on.  What is far from every name in the end is compared with those
    whose length allows the best distance so far.
    """
    first = pop.groupBy(F.length("_p").alias("_n")).agg(F.min("_p").alias("_p"))
    lengths = rest.select(F.length("_s").alias("_n")).distinct()
    by_length = Window.partitionBy(F.lit(0)).orderBy("_n")  # a row a length
    upto, beyond = by_length.rangeBetween(Window.unboundedPreceding, 0), by_length.rangeBetween(1, Window.unboundedFollowing)
    longer = F.min(F.when(F.col("_p").isNotNull(), F.struct(F.col("_n").alias("d"), F.col("_p").alias("n")))).over(beyond)
    shorter = F.min("_p").over(upto)
    bound = (lengths.withColumn("_asked", F.lit(True)).unionByName(first, allowMissingColumns=True)
             .withColumn("_best", F.when(shorter.isNotNull(), F.struct(F.col("_n").alias("d"), shorter.alias("n"))).otherwise(longer))
             .where("_asked").select("_n", "_best"))
    open_ = rest.where("_s != ''").withColumn("_n", F.length("_s")).join(bound, "_n").select("_s", "_n", "_best")
    settled = []
    for size in GRAMS:
        # Pairs that meet on several grams are compared again: cheaper than a shuffle of pairs.
        near = gram_candidates(open_, pop, size).select("_s", F.struct(
            F.levenshtein("_s", "_p").alias("d"), F.col("_p").alias("n")).alias("_best"))
        better = near.groupBy("_s").agg(F.min("_best").alias("_near"))
        known = checkpoint(open_.join(better, "_s", "left").select("_s", "_n", F.least("_best", "_near").alias("_best")))
        sure = F.col("_n") + (size - 1) - size * F.col("_best.d") >= 1
        settled.append(known.where(sure).select("_s", "_best"))
        open_ = known.where(~sure)
    last = length_candidates(open_, pop).select("_s", F.least("_best", nearest_name(F.col("_s"), F.col("_names"))).alias("_best"))
    out = last.groupBy("_s").agg(F.min("_best").alias("_best"))
    for more in settled:
        out = out.unionByName(more)
    none = F.struct(F.lit(EMPTY_DISTANCE).alias("d"), F.lit(None).cast("string").alias("n"))
    far = F.when(F.col("_best.d") >= EMPTY_DISTANCE, none).otherwise(F.struct(F.col("_best.d").alias("d"), F.col("_best.n").alias("n")))
    return out.select("_s", far.alias("_m")).unionByName(rest.where("_s = ''").select("_s", none.alias("_m")))


def deletions(word: Column, depth: int = CANDIDATE_DISTANCE) -> Column:
    """The word and every form with up to ``depth`` characters removed."""
    def drop_one(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.length(w))
        cut = F.transform(at, lambda i: F.concat(
            F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
        return F.when(F.length(w) > 0, cut).otherwise(F.array(w))

    forms = F.array(word)
    for _ in range(depth):
        forms = F.array_distinct(F.concat(forms, F.flatten(F.transform(forms, drop_one))))
    return forms


def typosquat_candidates(df: DataFrame, popular: DataFrame, sld_col: str = "sld") -> DataFrame:
    """Every popular name within edit distance 1..2 of each distinct name.

    Equi-join on deletion forms (two strings at distance <= 2 share one), then
    an exact check.  Works for popular lists of any size and never compares
    names that share no form.
    """
    slds = df.select(F.col(sld_col).alias("sld")).where(F.col("sld") != "").distinct()
    pop = popular.select(F.col("name").alias("similar_domain")).where(F.col("name") != "").distinct()
    left = slds.withColumn("_k", F.explode(deletions(F.col("sld"))))
    right = pop.withColumn("_k", F.explode(deletions(F.col("similar_domain"))))
    distance = F.levenshtein("sld", "similar_domain", CANDIDATE_DISTANCE)
    # Pairs meeting on several forms are merged after the cheap check.
    return (left.join(right, "_k").withColumn("distance", distance)
            .where(F.col("distance").between(1, CANDIDATE_DISTANCE))
            .groupBy("sld", "similar_domain").agg(F.min("distance").alias("distance")))
