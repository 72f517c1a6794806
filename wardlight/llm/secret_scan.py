"""Secrets in text: known shapes, and strings that a battery of tests can't tell from random.

Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.session import scratch_path

KINDS = ("assign", "access", "hex", "random")
BASE = KINDS[:3]
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Strings long enough for the tests.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"

LOWER_HEX, UPPER_HEX = "0123456789abcdef", "0123456789ABCDEF"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
FALSE_DISCOVERY = 0.05
#: p-values are counted in so many steps.
STEPS = 10_000


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


_NO_SPANS = "cast(array() as array<struct<s:int,e:int>>)"


def spans_of(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """array<struct<s,e>> of the matches, left to right, whose ``group`` has ``least`` characters.

    Where a text has a match, it is split at the matches; lengths of the parts and the
    matches add up to the offsets.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(f: Column) -> Column:
        def walk(gaps: Column, inner: Column) -> Column:
            def step(acc: Column, i: Column) -> Column:
                start = acc["at"] + F.length(F.get(gaps, i))
                end = start + F.length(F.get(f, i))
                one = F.array(F.struct(start.alias("s"), end.alias("e")))
                some = F.when(F.length(F.get(inner, i)) >= least, F.concat(acc["out"], one)).otherwise(acc["out"])
                return F.struct(end.alias("at"), some.alias("out"))
            first = F.struct(F.lit(0).alias("at"), F.expr(_NO_SPANS).alias("out"))
            return F.aggregate(F.sequence(F.lit(0), F.size(f) - 1), first, step)["out"]
        inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else f
        return F.when(F.size(f) > 0, let(F.split(text, pattern, -1), lambda g: let(inner, lambda x: walk(g, x)))
                      ).otherwise(F.expr(_NO_SPANS))

    return let(found, placed)


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the standard normal distribution (a rational approximation, error below 2e-7)."""
    x = F.abs(z) / (2 ** 0.5)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.greatest(F.lit(1e-300), F.least(F.lit(1.0), poly * F.exp(-x * x)))


def encoding_of(token: Column) -> Column:
    """hex, base32 or base64 by the characters that occur; null for words and numbers."""
    digits, letters = token.rlike("[0-9]"), token.rlike("[A-Za-z]")
    return (F.when(~digits | ~letters, None)
            .when(token.rlike("^[0-9a-f]+$") | token.rlike("^[0-9A-F]+$"), "hex")
            .when(token.rlike("^[A-Z2-7]+$"), "base32")
            .when(token.rlike("[a-z]") & token.rlike("[A-Z]"), "base64"))


def randomness(token: Column, encoding: Column) -> Column:
    """p of three tests against uniform random characters, combined by Fisher's method.

    Chi-squared over the alphabet (two-sided, Wilson-Hilferty), runs above and below the
    alphabet's middle, and serial correlation at lag one.
    """
    size = F.when(encoding == "hex", 16.0).when(encoding == "base32", 32.0).otherwise(64.0)
    letters = (F.when(encoding == "base32", F.lit(BASE32)).when(encoding == "base64", F.lit(BASE64))
               .when(token.rlike("[a-f]"), F.lit(LOWER_HEX)).otherwise(F.lit(UPPER_HEX)))
    plain = F.translate(token, "-_", "+/")
    values = F.transform(F.split(plain, ""), lambda c: F.instr(letters, c) - F.lit(1.0))

    def tests(v: Column) -> Column:
        n = F.size(v).cast("double")
        squares = F.aggregate(
            F.sequence(F.lit(0), size.cast("int") - 1), F.lit(0.0),
            lambda a, k: let(F.size(F.filter(v, lambda x: x == k)), lambda c: a + c * c))
        free = size - 1
        chi = size / n * squares - n
        spread = F.lit(2.0) / (9 * free)
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
        up = F.size(F.filter(v, lambda x: x >= size / 2)).cast("double")
        down = n - up
        runs = F.aggregate(F.sequence(F.lit(1), F.size(v) - 1), F.lit(1.0), lambda a, i: a + F.when(
            (F.get(v, i) >= size / 2) != (F.get(v, i - 1) >= size / 2), 1.0).otherwise(0.0))
        both = 2 * up * down
        variance = both * (both - n) / (n * n * (n - 1))
        z_runs = F.when(variance > 0, (runs - both / n - 1) / F.sqrt(variance)).otherwise(F.lit(40.0))
        mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
        power = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        serial = F.aggregate(F.sequence(F.lit(1), F.size(v) - 1), F.lit(0.0), lambda a, i: a + (
            F.get(v, i) - mean) * (F.get(v, i - 1) - mean))
        z_serial = F.when(power > 0, (serial / power + 1 / n) * F.sqrt(n)).otherwise(F.lit(40.0))
        half = -(F.log(normal_tail(z_chi)) + F.log(normal_tail(z_runs)) + F.log(normal_tail(z_serial)))
        return F.exp(-half) * (1 + half + half * half / 2)

    return let(values, tests)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base: spans of the known shapes, tried: tested strings) for each row of ``docs``.

    ``base`` is array<struct<s,k,e>> (k the kind's number) by start and kind; ``tried``
    is array<struct<s,e,stratum,p>>, a stratum being an encoding and a power of two of
    length.  Offsets are code points.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    numbered = lambda spans, k: F.transform(spans, lambda x: F.struct(
        x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))
    base = F.array_sort(F.concat(numbered(spans_of(t, ASSIGN, 2, 12), 0), numbered(spans_of(t, ACCESS), 1),
                                 numbered(spans_of(t, HEX), 2)))

    def tested(x: Column) -> Column:
        token = F.substring(t, x["s"] + 1, x["e"] - x["s"])
        return let(token, lambda tok: let(encoding_of(tok), lambda enc: F.struct(
            x["s"].alias("s"), x["e"].alias("e"),
            F.concat_ws(":", enc, F.floor(F.log2(F.length(tok))).cast("string")).alias("stratum"),
            F.when(enc.isNotNull(), randomness(tok, enc)).alias("p"))))

    tried = F.filter(F.transform(spans_of(t, CANDIDATE), tested), lambda x: x["p"].isNotNull())
    return docs.select(F.col(key), base.alias("base"), tried.alias("tried"))


def rejected_up_to(tried: DataFrame, rate: float) -> dict[str, float]:
    """Per stratum, the largest p at which randomness is rejected (Benjamini-Hochberg at ``rate``).

    p is counted in ``STEPS`` steps, so a stratum's ranking is at most that many rows
    however many strings it holds, and only one number for each of a few dozen strata
    comes to the driver.
    """
    counts = (tried.select(F.col("x.stratum").alias("stratum"),
                           F.ceil(F.col("x.p") * STEPS).alias("step"))
              .groupBy("stratum", "step").agg(F.count("*").alias("n")))
    upto = Window.partitionBy("stratum").orderBy("step")
    every = Window.partitionBy("stratum")
    ranked = counts.select("stratum", "step", F.sum("n").over(upto).alias("rank"), F.sum("n").over(every).alias("m"))
    good = ranked.where(F.col("step") / STEPS <= rate * F.col("rank") / F.col("m"))
    return {r["stratum"]: r["top"] / STEPS for r in good.groupBy("stratum").agg(F.max("step").alias("top")).collect()}


def find_secrets(docs: DataFrame, rate: float = FALSE_DISCOVERY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, random) spans for each row of ``docs``.

    Base spans stay whatever the tests say.  A tested string that overlaps no base span
    is added as "random" unless its stratum's false-discovery control rejects that it is
    random: short strings are only weighed against short ones, where a test has little
    power, so many short words can't lift the bar for long keys or the other way round.

    Null and empty texts have no spans; repeated rows repeat; other columns are not read.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "secrets")
    scan(docs, key, text).write.parquet(path)
    found = spark.read.parquet(path)
    cuts = rejected_up_to(found.select(F.explode("tried").alias("x")), rate)
    by_stratum = F.create_map(*(F.lit(v) for kv in cuts.items() for v in kv)) if cuts else None
    limit = lambda x: F.lit(-1.0) if by_stratum is None else F.coalesce(by_stratum[x["stratum"]], F.lit(-1.0))
    random = F.filter("tried", lambda x: (F.ceil(x["p"] * STEPS) / STEPS > limit(x)) & ~F.exists(
        "base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return found.select(F.col(key), "base", F.transform(random, lambda x: F.struct(
        x["s"].alias("s"), F.lit(3).alias("k"), x["e"].alias("e"))).alias("random"))


def joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        key, *(count(i).alias(f"n_{k}") for i, k in enumerate(BASE)), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "random"))).alias("spans"), F.size("random").cast("long").alias("n_random"))
