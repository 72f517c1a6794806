"""A store of computed features, bucketed by domain so that joins leave it where it lies."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from wardlight.schemas import FEATURE_NAMES

BUCKETS = 64


class FeatureStore:
    """(domain, 48 features) as a table of ``buckets`` files' groups, sorted by domain inside.

    Looking up or joining domains moves the asked side only, whatever the store holds.
    ``path`` is on storage that driver and executors share; a later session opens the
    same path again under any name.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets

    def add(self, features: DataFrame) -> None:
        """Appends rows of new domains: one file a bucket."""
        rows = features.select("domain", *FEATURE_NAMES).repartition(self.buckets, "domain")
        self._known()
        (rows.write.mode("append").bucketBy(self.buckets, "domain").sortBy("domain").option("path", self.path)
         .format("parquet").saveAsTable(self.name))

    def _known(self) -> bool:
        """Whether the table is there; one that an earlier session left at the path is declared anew."""
        if self.spark.catalog.tableExists(self.name):
            return True
        try:
            schema = self.spark.read.parquet(self.path).schema
        except AnalysisException:
            return False
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        self.spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet CLUSTERED BY (domain) SORTED BY (domain) "
                       f"INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        return True

    def read(self) -> DataFrame:
        if not self._known():
            raise ValueError(f"{self.path} holds no features")
        return self.spark.table(self.name)
