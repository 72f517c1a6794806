"""Work of the training queries that must not be done twice or by one task."""

import contextlib
import io

from pyspark.sql import functions as F

from wardlight.operators import ensembles
from wardlight.plans import featuring


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_staged_losses_score_each_row_once(spark):
    nodes = spark.createDataFrame([(0, 0, 0, 0.5, 1, 2, 0.0, 0.5, 2.0), (0, 1, -1, 0.0, -1, -1, -1.0, 0.5, 1.0),
                                   (0, 2, -1, 0.0, -1, -1, 1.0, 0.5, 1.0)], ensembles.NODE_SCHEMA)
    rows = spark.createDataFrame([([0.0] * 48,), ([1.0] * 48,)], "features array<double>")
    staged = ensembles.staged_margins(ensembles.score_nodes(rows, nodes), nodes).select(F.posexplode("staged").alias("round", "m"))
    assert plan(staged).count("ArrowEvalPython") == 2
    assert sorted(r["m"] for r in staged.collect()) == [-1.0, 1.0]


def test_many_hosts_are_dealt_over_tasks(spark, folder):
    hosts = lambda **more: featuring.assembled(spark, folder, include_network=False, **more)
    assert "REPARTITION_BY_NUM" in plan(hosts(per_task=50))
    assert "REPARTITION_BY_NUM" not in plan(hosts(per_task=20_000))
    assert sorted(map(str, hosts(per_task=50).collect())) == sorted(map(str, hosts().collect()))
