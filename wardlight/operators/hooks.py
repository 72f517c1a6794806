"""Places where callers plug in their own extractors, encoders and models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.functions.scores import SUSPICIOUS_AT, category_token
from wardlight.operators.explain import explain_long


def per_domain(fn: Callable[[pd.Series], pd.DataFrame], schema: str, col: str = "domain") -> Callable[[DataFrame], DataFrame]:
    """A feature extractor from a function over a batch of domains.

    ``fn`` returns one row per domain with the columns of ``schema``; it runs
    on Arrow batches inside the tasks.
    """
    added = T.StructType.fromDDL(schema)

    def extract(df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                new = fn(pdf[col]).reset_index(drop=True)
                yield pd.concat([pdf.reset_index(drop=True), new[added.names]], axis=1)

        return df.mapInPandas(run, T.StructType([*df.schema.fields, *added.fields]))

    return extract


def encode_with(df: DataFrame, column: str, encoder: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Replaces a categorical column by a caller's vectorised encoder."""
    def run(tokens: pd.Series) -> pd.Series:
        return encoder(tokens).astype(float)

    return df.withColumn(column, F.pandas_udf(run, "double")(category_token(F.col(column))))


def score_with(df: DataFrame, model, features: str = "features") -> DataFrame:
    """Scores with any fitted classifier that outputs a probability vector."""
    from wardlight.operators.learning import with_vector

    scored = model.transform(with_vector(df, features))
    return scored.withColumn("score", F.get(vector_to_array("probability"), F.lit(1))).drop(
        "vector", "rawPrediction", "probability", "prediction")


def explain_with(df: DataFrame, contributions: Callable[[DataFrame], DataFrame], top_k: int = 3) -> DataFrame:
    """Reasons from a caller's contribution function (long form)."""
    return explain_long(contributions(df), top_k=top_k)


def with_analysis_id(df: DataFrame) -> DataFrame:
    """Flagged verdicts get an id that is stable across retries."""
    text = F.concat_ws("|", F.lower("domain"), F.unix_micros("created_at").cast("string"))
    return df.withColumn("analysis_id", F.when(F.col("score") >= SUSPICIOUS_AT, F.sha2(text, 256)))
