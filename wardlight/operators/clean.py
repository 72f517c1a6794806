"""Cleaning of labelled domain sets and numeric hygiene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions.scores import hash_encode
from wardlight.functions.text import strip
from wardlight.operators.bounds import computed_once


def _prepared(df: DataFrame) -> DataFrame:
    """Trimmed domain, numeric label and the rule (if any) that drops the row."""
    number = strip(F.col("label").cast("string")).try_cast("double")
    work = computed_once(df, {"domain": F.lower(strip(F.col("domain"))), "_number": number})
    # Truncation precedes the range test, so 0.5 counts as 0.
    fits = F.abs(F.col("_number")) < 2147483648.0
    whole = F.when(F.col("_number") < 0, F.ceil("_number")).otherwise(F.floor("_number"))
    work = computed_once(work, {"_label": F.when(fits, whole.cast("int"))})
    missing = F.col("_number").isNull() | F.isnan("_number")
    rule = (F.when(F.coalesce(F.col("domain"), F.lit("")) == "", "empty_domain")
            .when(missing, "non_numeric_label")
            .when(~F.coalesce(F.col("_label").isin(0, 1), F.lit(False)), "label_out_of_range"))
    return work.withColumn("dropped_by", rule)


def clean_labeled(df: DataFrame) -> DataFrame:
    """Valid rows with an integer label in {0, 1}; other columns kept."""
    return (_prepared(df).where(F.col("dropped_by").isNull())
            .withColumn("label", F.col("_label")).drop("_number", "_label", "dropped_by"))


def drop_report(df: DataFrame) -> DataFrame:
    """One row: how many rows each cleaning rule removes."""
    rules = ["empty_domain", "non_numeric_label", "label_out_of_range"]
    return _prepared(df).agg(
        F.count("*").alias("n_raw"),
        *[F.count_if(F.col("dropped_by") == r).alias(f"dropped_{r}") for r in rules],
        F.count_if(F.col("dropped_by").isNull()).alias("n_valid"))


def label_conflicts(df: DataFrame) -> DataFrame:
    """Domains that carry both labels (labels are 0/1, so min and max suffice)."""
    return (df.groupBy("domain").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"))
            .where(F.col("_lo") < F.col("_hi")).select("domain", F.lit(2).cast("long").alias("n_labels")))


def dedupe_first(df: DataFrame, order_col: str = "row_id", key: str = "domain") -> DataFrame:
    """First row per key in file order: one map-side-combined aggregate."""
    rest = [c for c in df.columns if c != key]
    return (df.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order_col)).alias("_r"))
            .select(*[F.col("_r")[c].alias(c) if c != key else F.col(key) for c in df.columns]))


def class_balance(df: DataFrame, label_col: str = "label") -> DataFrame:
    benign, malicious = (F.count_if(F.col(label_col) == v) for v in (0, 1))
    counts = df.agg(benign.alias("benign"), malicious.alias("malicious"))
    total = F.nullif(F.col("benign") + F.col("malicious"), F.lit(0).cast("long"))
    return counts.withColumns({
        "benign_share": F.try_divide("benign", total), "malicious_share": F.try_divide("malicious", total)})


def coerce_numeric(df: DataFrame, columns: list[str], strings: str = "hash") -> DataFrame:
    """Finite doubles: booleans 0/1; null, NaN and infinities 0.

    Text that is not a number becomes its hash code (``hash``) or 0 (``zero``).
    """
    types = dict(df.dtypes)

    def fixed(name: str) -> Column:
        col = F.col(name)
        if types[name] == "string":
            number = col.try_cast("double")
            if strings == "hash":
                number = F.when(col.isNotNull(), F.coalesce(number, hash_encode(col).cast("double")))
        else:
            number = col.cast("double")
        odd = number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))
        return F.when(odd, F.lit(0.0)).otherwise(number)

    return df.withColumns({c: fixed(c) for c in columns})


def infinite_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a +-infinite feature, and how many; NaN is allowed."""
    found = sum((F.coalesce(F.abs(F.col(c).cast("double")) == float("inf"), F.lit(False)).cast("int")
                 for c in columns), F.lit(0))
    return df.withColumn("n_infinite", found).where(F.col("n_infinite") > 0)


def check_vector(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fails on missing columns now, on infinite values when executed."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"expected {len(columns)} features, missing {missing[:5]}")
    bad = sum((F.coalesce(F.abs(F.col(c).cast("double")) == float("inf"), F.lit(False)).cast("int")
               for c in columns), F.lit(0))
    alarm = F.when(bad > 0, F.raise_error(F.lit("feature row has infinite values")).cast("double"))
    first = columns[0]
    return df.withColumn(first, F.when(alarm.isNull(), F.col(first)))
