"""Session construction and the few settings the operators rely on."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "wardlight",
                  **conf: object) -> SparkSession:
    """A session with adaptive execution, skew-join splitting and UTC time.

    On a cluster leave ``master`` unset (spark-submit supplies it) and let AQE
    coalesce from a generous ``spark.sql.shuffle.partitions``.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def ensure_utc(spark: SparkSession) -> SparkSession:
    """Pin the session time zone; timestamps in the logs are UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one in the warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


def _run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/wardlight/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for state, output or a table that cuts lineage."""
    return f"{_run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written_once(spark: SparkSession, name: str, write: Callable[[str], None]) -> str:
    """The application's path ``name`` in the shared folder, filled by ``write`` on first use.

    What a lost driver left half-written has no success mark and is written again.
    """
    jvm = spark.sparkContext._jvm
    path = f"{_run_dir(spark)}/{name}"
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        write(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote to scratch paths; call it when no result is read any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_run_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint(df):
    """Cut lineage through the shared checkpoint folder (reliable, not local)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def written(df, name: str, partitions: int | None = None):
    """The frame as Parquet files in the shared folder, for what is read several times in parts of its columns."""
    path = scratch_path(df.sparkSession, name)
    (df if partitions is None else df.repartition(partitions)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
