"""Categorical vocabularies and scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardlight.functions.scores import category_token, hash_encode
from wardlight.operators.bounds import broadcast_if_small
from wardlight.schemas import CATEGORICAL_FEATURES, CONTINUOUS_FEATURES, UNKNOWN


def fit_vocab(df: DataFrame, columns: list[str] = CATEGORICAL_FEATURES) -> DataFrame:
    """(feature, token, code): sorted distinct tokens, ``unknown`` last.

    Tokens are counted off in two steps (rank inside a two-character prefix,
    plus the size of earlier prefixes), so no task orders a whole vocabulary.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), category_token(F.col(c)).alias("token"))
                      for c in columns])
    tokens = (df.select(F.inline(pairs)).distinct().where(F.col("token") != UNKNOWN)
              .withColumn("_p", F.substring("token", 1, 2)))
    prefixes = tokens.groupBy("feature", "_p").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("feature").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = prefixes.select("feature", "_p", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("feature", "_p").orderBy("token")
    codes = tokens.join(base, ["feature", "_p"]).select(
        "feature", "token", (F.col("_base") + F.row_number().over(inside) - 1).cast("long").alias("code"))
    spark = df.sparkSession
    names = spark.createDataFrame([(c,) for c in columns], "feature string")
    last = names.join(prefixes.groupBy("feature").agg(F.sum("_n").alias("_n")), "feature", "left").select(
        "feature", F.lit(UNKNOWN).alias("token"), F.coalesce("_n", F.lit(0)).cast("long").alias("code"))
    return codes.unionByName(last)


def apply_vocab(df: DataFrame, vocab: DataFrame, columns: list[str] = CATEGORICAL_FEATURES) -> DataFrame:
    """Replaces each categorical column by its code; unseen reads as unknown."""
    vocab = vocab.select("feature", "token", "code")
    unknown = vocab.where(F.col("token") == UNKNOWN)
    for name in columns:
        mine = vocab.where(F.col("feature") == name).select(
            F.col("token").alias("_token"), F.col("code").alias("_code"))
        fallback = unknown.where(F.col("feature") == name).agg(F.max("code")).scalar()
        df = (df.withColumn("_key", category_token(F.col(name)))
              .join(broadcast_if_small(mine), F.col("_key") == F.col("_token"), "left")
              .withColumn(name, F.coalesce(F.col("_code"), fallback))
              .drop("_key", "_token", "_code"))
    return df


def hash_encoded(df: DataFrame, columns: list[str] = CATEGORICAL_FEATURES) -> DataFrame:
    return df.withColumns({c: hash_encode(F.col(c)) for c in columns})


def apply_mapping(df: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Plain (token, code) map: the token's code, else the code of ``unknown``,
    else the token's hash."""
    fallback = mapping.where(F.col("token") == UNKNOWN).agg(F.max("code").cast("long")).scalar()
    pairs = mapping.select(F.col("token").alias("_token"), F.col("code").cast("long").alias("_code"))
    return (df.withColumn("_key", category_token(F.col(column)))
            .join(broadcast_if_small(pairs), F.col("_key") == F.col("_token"), "left")
            .withColumn(column, F.coalesce(F.col("_code"), fallback, hash_encode(F.col(column))))
            .drop("_key", "_token", "_code"))


def merge_vocab(first: DataFrame, train: DataFrame, columns: list[str] = CATEGORICAL_FEATURES) -> DataFrame:
    """Vocabulary for continued training: a feature with real categories keeps
    its codes, one that was constant before is fitted again."""
    sizes = first.groupBy("feature").agg(F.count("*").alias("_n"))
    present = {r["feature"]: r["_n"] for r in sizes.where(F.col("feature").isin(*columns)).collect()}
    absent = [c for c in columns if c not in present]
    if absent:
        raise ValueError(f"no vocabulary for {absent}")
    refit = [c for c in columns if present[c] <= 1]
    kept = first.where(~F.col("feature").isin(*refit)) if refit else first
    kept = kept.withColumn("refit", F.lit(False))
    if not refit:
        return kept
    return kept.unionByName(fit_vocab(train, refit).withColumn("refit", F.lit(True)))


def fit_scaler(df: DataFrame, columns: list[str] = CONTINUOUS_FEATURES) -> DataFrame:
    """One row: mean and population deviation per column (0 reads as 1)."""
    aggs = [F.avg(F.col(c).cast("double")).alias(f"{c}__mean") for c in columns]
    aggs += [F.stddev_pop(F.col(c).cast("double")).alias(f"{c}__dev") for c in columns]
    stats = df.agg(*aggs)
    return stats.withColumns({f"{c}__dev": F.when(F.col(f"{c}__dev") > 0, F.col(f"{c}__dev")).otherwise(1.0)
                              for c in columns})


def apply_scaler(df: DataFrame, scaler: DataFrame, columns: list[str] = CONTINUOUS_FEATURES) -> DataFrame:
    stats = scaler.select(F.struct("*")).scalar()
    return df.withColumns({
        c: (F.col(c).cast("double") - stats[f"{c}__mean"]) / stats[f"{c}__dev"] for c in columns})
