"""Reasons for a score, from per-feature contributions.

Two forms with the same result: ``explain`` works on one wide row with a
contribution array (no shuffle at all); the ``long`` functions work on
(row, feature, value, contribution) tables, where every window covers the at
most 48 rows of one scored row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardlight.reasons import MANY_KEYWORDS, ONE_KEYWORD, RULES
from wardlight.schemas import CATEGORICAL_FEATURES, FEATURE_NAMES, NETWORK_FEATURES

MIN_SHARE = 0.01
POOL = 12
TOP_REASONS = 3


def rounded_value(value: Column) -> Column:
    """Half-even rounding; what is not a number reads 0."""
    return F.bround(F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0)), 0).cast("long")


def _gate(gate: str, value: Column) -> Column:
    kind, *bounds = gate.split()
    real = F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))
    if kind in ("on", "off"):
        return real >= 0.5 if kind == "on" else real < 0.5
    if kind == "real":
        return real >= float(bounds[0])
    low, *high = (int(b) for b in bounds)
    n = rounded_value(value)
    return n.between(low, high[0]) if high else n >= low


def _keywords(words: Column) -> Column:
    quoted = F.array_join(F.transform(words, lambda w: F.concat(F.lit("'"), w, F.lit("'"))), ", ")
    lead = F.when(F.size(words) == 1, ONE_KEYWORD).otherwise(MANY_KEYWORDS)
    return F.when(F.size(words) > 0, F.concat(lead, quoted))


def _text(template: str, value: Column, context: dict[str, Column]) -> Column | None:
    """The filled-in template: null when a quoted column is empty, None when
    the column is not available at all."""
    if template == "{keywords}":
        return _keywords(context["matched_keywords"]) if "matched_keywords" in context else None
    for name in ("tld", "brand", "similar_domain"):
        if "{" + name + "}" in template:
            if name not in context:
                return None
            quote = F.nullif(context[name], F.lit(""))
            if name == "tld":
                quote = F.concat(F.lit("."), F.regexp_replace(quote, r"^\.", ""))
            before, after = template.split("{" + name + "}")
            return F.concat(F.lit(before), quote, F.lit(after))
    if "{n}" in template:
        before, after = template.split("{n}")
        return F.concat(F.lit(before), rounded_value(value).cast("string"), F.lit(after))
    return F.lit(template)


def reason_text(feature: str, value: Column, context: dict[str, Column] | None = None) -> Column:
    """The reason a feature value gives, or null."""
    options = []
    for name, _, gate, template in RULES:
        text = _text(template, value, context or {}) if name == feature else None
        if text is not None:
            options.append(F.when(_gate(gate, value), text))
    return F.coalesce(*options) if options else F.lit(None).cast("string")


CATEGORY_OF = {name: category for name, category, _, _ in RULES}


def _context(df: DataFrame) -> dict[str, Column]:
    names = ("tld", "brand", "similar_domain", "matched_keywords")
    return {n: F.col(n) for n in names if n in df.columns and dict(df.dtypes)[n] != "bigint"}


def explain(df: DataFrame, contributions: str = "contributions", top_k: int = TOP_REASONS,
            context: bool = False, label_col: str | None = "label") -> DataFrame:
    """Adds ``reasons`` to rows with the 48 features and a contribution array.

    Row-local: no shuffle.  Safe rows get no reasons.
    """
    ctx = _context(df) if context else {}
    net = F.coalesce(F.col("network_features_available").cast("double"), F.lit(0.0)) >= 0.5
    entries = []
    for i, name in enumerate(FEATURE_NAMES):
        value = F.lit(0) if name in CATEGORICAL_FEATURES else F.col(name)
        usable = net if name in NETWORK_FEATURES else F.lit(True)
        entries.append(F.struct(
            F.get(contributions, F.lit(i)).alias("c"), F.lit(-i).alias("order"), usable.alias("usable"),
            F.lit(CATEGORY_OF.get(name)).cast("string").alias("category"),
            reason_text(name, value, ctx).alias("text")))
    work = df.withColumn("_e", F.array(*entries))
    total = F.aggregate(contributions, F.lit(0.0), lambda a, c: a + F.when(c > 0, c).otherwise(0.0))
    work = work.withColumn("_total", F.when(total > 0, total).otherwise(1.0))
    strong = F.filter("_e", lambda e: (e["c"] > 0) & (e["c"] / F.col("_total") >= MIN_SHARE) & e["usable"])
    work = work.withColumn("_pool", F.slice(F.reverse(F.array_sort(strong)), 1, POOL))
    told = F.filter("_pool", lambda e: e["text"].isNotNull())
    work = work.withColumn("_told", told)
    first = F.filter("_told", lambda e, i: F.array_position(
        F.transform("_told", lambda t: t["category"]), e["category"]) == i + 1)
    reasons = F.transform(F.slice(first, 1, top_k), lambda e: e["text"])
    if label_col:
        reasons = F.when(F.col(label_col) != "safe", reasons).otherwise(F.array().cast("array<string>"))
    return work.withColumn("reasons", reasons).drop("_e", "_total", "_pool", "_told")


def rank_contributions(df: DataFrame, key: str = "row_key") -> DataFrame:
    """Strong pushes toward malicious with ``rank`` 1..12 per row.

    Input: (key, feature, value, contribution), a feature at most once per
    row; network features are dropped when the availability flag is off.
    """
    row = Window.partitionBy(key)
    total = F.sum(F.when(F.col("contribution") > 0, F.col("contribution")).otherwise(0.0)).over(row)
    flag = F.max(F.when(F.col("feature") == "network_features_available",
                        F.nanvl(F.col("value"), F.lit(0.0)))).over(row)
    work = df.withColumns({"_total": total, "_net": F.coalesce(flag >= 0.5, F.lit(True))})
    share = F.col("contribution") / F.when(F.col("_total") > 0, F.col("_total")).otherwise(1.0)
    work = work.where((F.col("contribution") > 0) & (share >= MIN_SHARE)
                      & (F.col("_net") | ~F.col("feature").isin(*NETWORK_FEATURES)))
    order = {name: i for i, name in enumerate(FEATURE_NAMES)}
    place = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("feature"))
    ranked = work.withColumn("_place", place).withColumn(
        "rank", F.row_number().over(row.orderBy(F.desc("contribution"), "_place")))
    return ranked.where(F.col("rank") <= POOL).drop("_total", "_net", "_place")


def render_long(df: DataFrame, context: dict[str, Column] | None = None) -> DataFrame:
    """Adds ``category`` and ``text`` per (feature, value) row."""
    text, category = F.lit(None).cast("string"), F.lit(None).cast("string")
    chain_t, chain_c = F, F
    for name in CATEGORY_OF:
        here = F.col("feature") == name
        chain_t = chain_t.when(here, reason_text(name, F.col("value"), context))
        chain_c = chain_c.when(here, F.lit(CATEGORY_OF[name]))
    return df.withColumns({"text": chain_t.otherwise(text), "category": chain_c.otherwise(category)})


def dedupe_reasons(df: DataFrame, key: str = "row_key", top_k: int = TOP_REASONS) -> DataFrame:
    """First reason per category, then the ``top_k`` best per row."""
    told = df.where(F.col("text").isNotNull())
    per_category = Window.partitionBy(key, "category").orderBy("rank")
    per_row = Window.partitionBy(key).orderBy("rank")
    firsts = told.withColumn("_n", F.row_number().over(per_category)).where(F.col("_n") == 1)
    best = firsts.withColumn("position", F.row_number().over(per_row)).where(F.col("position") <= top_k)
    return best.drop("_n")


def explain_long(df: DataFrame, key: str = "row_key", top_k: int = TOP_REASONS) -> DataFrame:
    """(key, position, feature, text) for every row of a contribution table."""
    return dedupe_reasons(render_long(rank_contributions(df, key)), key, top_k).select(
        key, "position", "feature", "text")


def alternative_text(feature: Column, value_text: Column) -> Column:
    """A short wording that works for any feature: its name and value."""
    return F.concat(F.replace(feature, F.lit("_"), F.lit(" ")), F.lit(" ("), value_text, F.lit(") raised the score"))
