"""The training query runs the whole recipe, and boosting stops where patience does."""

import inspect
import random

import pytest
from pyspark.sql import functions as F

from wardlight.operators import learning
from wardlight.plans import learning as plans
from wardlight.schemas import FEATURE_NAMES


def rows(spark, n):
    rng = random.Random(7)
    made = []
    for i in range(n):
        x = [rng.random() for _ in FEATURE_NAMES]
        made.append((f"d{i}.com", x, int((x[0] > 0.6) != (rng.random() < 0.2))))
    return spark.createDataFrame(made, "domain string, features array<double>, label int").repartition(2).cache()


def counting(monkeypatch):
    """The rounds of each fit from now on."""
    fits, plain = [], learning.train_gbt
    monkeypatch.setattr(learning, "train_gbt", lambda *a, **k: fits.append(k["maxIter"]) or plain(*a, **k))
    return fits


def test_the_training_query_runs_the_recipe(spark, monkeypatch):
    calls, plain = [], learning.train_validated

    def stub(*args, **options):
        given = inspect.signature(plain).bind(*args, **options)
        given.apply_defaults()
        calls.append({**learning.RECIPE, **given.arguments, **given.arguments["params"]})
        return learning.model_nodes(learning.train_gbt(args[0], maxIter=1), spark), 1

    df = rows(spark, 200)
    monkeypatch.setattr(plans, "training_rows", lambda *_: df)
    monkeypatch.setattr(learning, "train_validated", stub)
    report = plans.train_and_evaluate(spark, "").collect()
    assert len(report) == 1 and report[0]["test_samples"] == learning.stratified_split(df).where("is_test").count()
    assert len(calls) == 1 and calls[0]["folds"] == 5 and calls[0]["patience"] == learning.PATIENCE == 50
    assert all(calls[0][name] == value for name, value in learning.RECIPE.items()) and calls[0]["maxIter"] == 1000
    assert calls[0]["train"].count() == df.count() - report[0]["test_samples"]


@pytest.mark.parametrize("patience", [1, 4])
def test_boosting_in_steps_is_boosting_at_once(spark, monkeypatch, patience):
    df = rows(spark, 300).withColumn("part", F.crc32("domain") % 3)
    train, held = df.where("part > 0"), df.where("part = 0")
    few = dict(maxIter=24, maxDepth=3, stepSize=0.3, patience=patience)
    nodes, rounds, losses = learning.train_with_patience(train, held, **few)
    assert len(losses) == 24 and rounds + patience < 24
    fits = counting(monkeypatch)
    same, again, looked = learning.train_with_patience(train, held, first=2, **few)
    assert again == rounds and sorted(map(str, same.collect())) == sorted(map(str, nodes.collect()))
    assert looked == pytest.approx(losses[:len(looked)], abs=1e-12)
    assert fits == [n for n in (2, 4, 8, 16, 24) if n < 2 * (rounds + patience) and n <= len(looked)] and len(looked) >= rounds + patience
    assert len(looked) < 24


def test_rounds_end_at_the_most_or_with_patience(spark, monkeypatch):
    train, held = rows(spark, 120), rows(spark, 60)
    for losses, most, fits, kept in (
            ([1 / i for i in range(1, 1001)], 1000, [100, 200, 400, 800, 1000], 1000),  # falls on and on
            ([1 / i for i in range(1, 1001)], 70, [70], 70),
            ([abs(i - 50) for i in range(1, 1001)], 1000, [100], 50),
            ([abs(i - 51) for i in range(1, 1001)], 1000, [100, 200], 51)):
        seen = []

        class Model:
            def __init__(self, n):
                self.n = n

            def evaluateEachIteration(self, _):
                return losses[:self.n]

        monkeypatch.setattr(learning, "train_gbt", lambda *a, **k: seen.append(k["maxIter"]) or Model(k["maxIter"]))
        monkeypatch.setattr(learning, "model_nodes", lambda *_: spark.range(2000).select(F.col("id").alias("tree")))
        nodes, rounds, _ = learning.train_with_patience(train, held, maxIter=most)
        assert seen == fits and rounds == kept == nodes.count() and kept == learning.best_round(losses[:most])


def test_folds_begin_with_what_sufficed_before(spark, monkeypatch):
    monkeypatch.setattr(learning, "FIRST_ROUNDS", 2)
    fits = counting(monkeypatch)
    learning.cross_validate(rows(spark, 240), 3, maxIter=4, maxDepth=2, patience=4)
    assert fits == [2, 4, 4, 4]
