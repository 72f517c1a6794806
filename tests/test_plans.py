"""The plans themselves: no row-wise Python, no cross joins, pruned scans."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from wardlight.operators.assemble import assemble, build_feature_matrix, label_join, pending
from wardlight.operators.lexical import structural_features
from wardlight.plans import catalog
from wardlight.session import scratch_path
from wardlight.sources.readers import load_labeled
from wardlight.sources.store import FeatureStore

NATIVE = [n for n in catalog.QUERIES if n.startswith((
    "src5", "nrm", "val", "cln", "sf", "nf", "asm", "enc", "scl", "jn", "ag", "wn", "sc1", "sc7", "log", "flt", "tk", "set"))]


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("name", NATIVE)
def test_plan_has_no_python_and_no_cross_join(spark, folder, name):
    plan = plan_of(catalog.QUERIES[name](spark, folder))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, f"{name} uses {bad}"


def test_lexical_features_do_not_shuffle(spark, folder):
    df = spark.read.parquet(f"{folder}/part.parquet").select(F.col("p_name").alias("domain"))
    plan = plan_of(structural_features(df))
    assert "Exchange" not in plan and "ReadSchema: struct<p_name:string>" in plan


def test_unused_features_are_pruned(spark, folder):
    df = spark.read.parquet(f"{folder}/part.parquet").select(F.col("p_name").alias("domain"))
    assert "levenshtein" not in plan_of(structural_features(df).select("entropy"))


def test_feature_store_is_not_shuffled(spark):
    """Neither the label join nor the search for missing domains moves the stored side."""
    names = [(f"h{i}.com", i % 2) for i in range(300)]
    labeled = spark.createDataFrame(names, "domain string, label int")
    path = scratch_path(spark, "store")
    store = FeatureStore(spark, "plan_store", path, 4)
    for part in (0, 1):
        store.add(assemble(labeled.where((F.col("label") == part) & (F.length("domain") < 8)).select("domain"), include_network=False))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (pending(labeled.select("domain"), store.read()), label_join(store.read(), labeled)):
            plan = plan_of(df)
            lines = plan.splitlines()
            at = next(i for i, line in enumerate(lines) if "plan_store" in line)
            column, above = len(lines[at]) - len(lines[at].lstrip(" :+-*")), []
            for line in reversed(lines[:at]):
                own = len(line) - len(line.lstrip(" :+-*"))
                if own < column:
                    column = own
                    above.append(line)
            joined = next(i for i, line in enumerate(above) if "Join" in line)
            assert "Bucketed: true" in lines[at] and not any("Exchange" in line for line in above[:joined]), plan
        matrix = build_feature_matrix(labeled, store=store.read(), include_network=False)
        assert matrix.count() == 300 and matrix.select("domain").distinct().count() == 300
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    spark.sql("DROP TABLE plan_store")
    again = FeatureStore(spark, "plan_store_again", path, 4)
    assert again.read().count() == 100
    again.add(assemble(spark.createDataFrame([("x.org",)], "domain string"), include_network=False))
    assert again.read().count() == 101 and [c.name for c in spark.catalog.listColumns("plan_store_again") if c.isBucket] == ["domain"]
    with pytest.raises(ValueError, match="no features"):
        FeatureStore(spark, "none", scratch_path(spark, "none")).read()


def test_csv_rows_are_numbered_in_file_order(spark):
    path = scratch_path(spark, "csv")
    rows = spark.range(5000).select(F.concat(F.lit("d"), "id").alias("domain"), F.lit("0").alias("label"))
    rows.repartitionByRange(7, F.col("domain")).sortWithinPartitions("domain").write.option("header", True).csv(path)
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")  # several splits a file
    try:
        got = load_labeled(spark, path)
        assert "Sort" not in plan_of(got.select("domain"))
        numbers = {r["domain"]: r["row_order"] for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
    assert numbers == {d: i for i, d in enumerate(sorted(f"d{i}" for i in range(5000)))}


def test_training_rows_compute_the_hosts_once(spark, folder, monkeypatch):
    from wardlight.plans import learning as plans

    seen, plain = spark.sparkContext.accumulator(0), plans.assembled

    def counted(*args, **options):
        def same(x):
            seen.add(1)
            return x

        return plain(*args, **options).withColumn("row_id", F.udf(same, "long")("row_id"))

    monkeypatch.setattr(plans, "assembled", counted)
    rows = plans.training_rows(spark, folder)
    assert rows.count() == seen.value == plain(spark, folder).count()
