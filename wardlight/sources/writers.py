"""Writing matrices, metrics, vocabularies and the verdict log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.operators.assemble import matrix_metadata


def save_features(df: DataFrame, path: str, fmt: str = "parquet", by_label: bool = False) -> None:
    """The matrix as Parquet or CSV plus a one-row JSON description."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unsupported format {fmt!r}; use parquet or csv")
    data = f"{path.rstrip('/')}.{fmt}"
    writer = df.write.mode("overwrite")
    if by_label:
        writer = writer.partitionBy("label")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(data)
    written = df.sparkSession.read.schema(df.schema).option("header", True).format(fmt).load(data)
    matrix_metadata(written).write.mode("overwrite").json(f"{path.rstrip('/')}.meta")


def save_metrics(metrics: DataFrame, path: str, version: str) -> None:
    """Metrics of one model version as JSON, one folder per version."""
    metrics.withColumn("evaluated_at", F.current_timestamp()).write.mode("overwrite").json(
        f"{path.rstrip('/')}/version={version}")


def save_vocab(vocab: DataFrame, path: str) -> None:
    vocab.write.mode("overwrite").partitionBy("feature").parquet(path)


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("feature string, token string, code long").parquet(path)


def append_analyses(df: DataFrame, path: str) -> None:
    """Appends verdicts to the log, one folder per day for cheap retention."""
    df.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def retain_days(spark: SparkSession, path: str, out: str, first_day: str) -> None:
    """Rewrites the log without the days before ``first_day`` (pruned scan)."""
    spark.read.parquet(path).where(F.col("day") >= first_day).write.mode("overwrite").partitionBy("day").parquet(out)
