"""Reading labelled sets, feature matrices and evaluation sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardlight.schemas import FEATURE_MATRIX, FEATURE_NAMES


def _lowered(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def in_file_order(rows: DataFrame, out: str) -> DataFrame:
    """Numbers the rows of a file scan from 0: files by path, splits by offset, rows as they stand.

    Each split is counted in its own task and the numbers start from the counts of the
    splits before it, so there is no sort of rows and no single task.
    """
    placed = rows.withColumns({"_file": F.col("_metadata.file_path"), "_from": F.col("_metadata.file_block_start"),
                               "_at": F.monotonically_increasing_id()})
    splits = placed.groupBy("_file", "_from").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(F.lit(0)).orderBy("_file", "_from").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    firsts = splits.select("_file", "_from", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return (placed.join(firsts, ["_file", "_from"]).withColumn(out, F.col("_at") + F.col("_shift"))
            .select(*rows.columns, out))


def load_labeled(spark: SparkSession, path: str) -> DataFrame:
    """(row_order, domain, label) from CSV with a header in any case.

    ``row_order`` numbers the rows from 0 in the order of files by path and of rows in them.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    df = _lowered(in_file_order(raw, "row_order"))
    missing = {"domain", "label"} - set(df.columns)
    if missing:
        raise ValueError(f"{path} lacks required column(s) {sorted(missing)}")
    return df.select("row_order", "domain", "label")


def load_features(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """A feature matrix from a frame, Parquet or CSV; all 49 columns required."""
    if isinstance(source, DataFrame):
        df = source
    elif source.rstrip("/").endswith(".csv"):
        df = spark.read.schema(FEATURE_MATRIX).option("header", True).option("enforceSchema", False).csv(source)
    else:
        df = spark.read.parquet(source)
    missing = [c for c in FEATURE_NAMES if c not in df.columns]
    if missing:
        raise ValueError(f"feature matrix lacks {len(missing)} column(s), e.g. {missing[:5]}")
    if "label" not in df.columns:
        raise ValueError("feature matrix has no 'label' column")
    return df


def load_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """A CSV/TSV test set; without a ``label`` column the last one is the label."""
    sep = "\t" if path.rstrip("/").endswith(".tsv") else ","
    df = spark.read.option("header", True).option("sep", sep).csv(path)
    lowered = {c.lower(): c for c in df.columns}
    label = lowered.get("label", df.columns[-1])
    rest = [F.col(c) if c.lower() in ("domain", "tld", "whois_country") else F.col(c).cast("double").alias(c)
            for c in df.columns if c != label]
    return df.select(*rest, F.col(label).cast("double").cast("int").alias("label"))
