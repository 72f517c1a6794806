import itertools
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardlight.operators import ensembles, hooks, learning, metrics
from wardlight.schemas import FEATURE_NAMES


def scored_rows(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.4)
        rows.append((i % 3, y, min(max(rng.gauss(0.4 + 0.25 * y, 0.2), 0.0), 1.0) if i % 4 else 0.5))
    return rows


def test_areas_match_all_pairs(spark):
    rows = scored_rows(500)
    got = metrics.evaluate(spark.createDataFrame(rows, "g int, y int, score double"), by=["g"]).collect()
    for r in got:
        pos = [s for g, y, s in rows if g == r["g"] and y == 1]
        neg = [s for g, y, s in rows if g == r["g"] and y == 0]
        wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
        assert r["auc_roc"] == pytest.approx(wins / len(pos) / len(neg), abs=1e-12)
        cut = sorted({s for g, y, s in rows if g == r["g"]}, reverse=True)
        ap, seen = 0.0, 0
        for c in cut:
            hits, total = sum(s >= c for s in pos), sum(s >= c for s in pos + neg)
            ap += (hits - seen) / len(pos) * hits / total
            seen = hits
        assert r["pr_auc"] == pytest.approx(ap, abs=1e-12)


def test_single_class_and_targets(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.2)], "y int, score double")
    report = metrics.evaluate(df)
    row = report.first()
    assert row["auc_roc"] != row["auc_roc"] and row["precision_score"] == 1.0 and row["false_positive_rate"] == 0.0
    checks = {r["metric"]: r["passed"] for r in metrics.check_targets(report).collect()}
    assert checks == {"auc_roc": False, "f1_score": False, "false_positive_rate": True}
    edge = spark.createDataFrame([(0.95, 0.9, 0.02)], "auc_roc double, f1_score double, false_positive_rate double")
    assert all(r["passed"] for r in metrics.check_targets(edge).collect())
    assert not any(r["passed"] for r in metrics.check_targets(edge, scheme="train").collect())


def matrix(spark, n=400):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        x = [rng.random() for _ in FEATURE_NAMES]
        rows.append((f"d{i}.com", x, int(x[0] + x[5] * x[7] + rng.random() * 0.3 > 1.0)))
    return spark.createDataFrame(rows, "domain string, features array<double>, label int").repartition(4).cache()


def test_node_table_equals_model_and_adds_up(spark):
    df = matrix(spark)
    model = learning.train_gbt(df, maxIter=4, maxDepth=3, minInstancesPerNode=5)
    nodes = learning.model_nodes(model, spark)
    ours = ensembles.score_nodes(df, nodes, contributions=True)
    both = ours.join(hooks.score_with(df, model).select("domain", F.col("score").alias("theirs")), "domain").collect()
    assert len(both) == 400
    for r in both:
        assert r["score"] == pytest.approx(r["theirs"], abs=1e-9)
        assert r["bias"] + sum(r["contributions"]) == pytest.approx(r["margin"], abs=1e-9)
    longer = learning.finetune(df, nodes, rounds=3, learning_rate=0.2, depth=3)
    assert longer.select("tree").distinct().count() == 7

    def loss(table):
        p, y = F.col("score"), F.col("label")
        return ensembles.score_nodes(df, table).agg(F.avg(-F.log(F.when(y == 1, p).otherwise(1 - p)))).first()[0]

    assert loss(longer) < loss(nodes)


def random_trees(rng, trees=6, width=5, depth=4):
    """Node rows of unbalanced trees that ask for some features more than once; leaves without rows too."""
    nodes = []
    for tree in range(trees):
        weight, waiting, made = rng.choice([0.5, 1.0]), [(0, depth, 200)], 1
        while waiting:
            node, left, cover = waiting.pop()
            if not left or (left < depth and rng.random() < 0.25):
                nodes.append((tree, node, -1, 0.0, -1, -1, rng.uniform(-1, 1), weight, float(cover)))
                continue
            part = rng.choice([0, cover // 3, cover // 2, cover])
            nodes.append((tree, node, rng.randrange(width), rng.choice([0.25, 0.5, 0.75]), made, made + 1, 0.0, weight, float(cover)))
            waiting += [(made, left - 1, part), (made + 1, left - 1, cover - part)]
            made += 2
    return nodes


def subset_shapley(nodes, x, width):
    """Contributions by the definition: every feature's gain over every subset of the others."""
    by = {(n[0], n[1]): n[2:] for n in nodes}

    def answer(tree, node, asked):
        f, cut, left, right, value, weight, cover = by[tree, node]
        if left < 0:
            return weight * value
        if f in asked:
            return answer(tree, left if x[f] <= cut else right, asked)
        part = by[tree, left][-1] / cover if cover else 0.5
        return part * answer(tree, left, asked) + (1 - part) * answer(tree, right, asked)

    def total(asked):
        return sum(answer(t, 0, asked) for t in {t for t, _ in by})

    out = [0.0] * width
    for f in range(width):
        rest = [g for g in range(width) if g != f]
        for size in range(width):
            weight = math.factorial(size) * math.factorial(width - size - 1) / math.factorial(width)
            for some in itertools.combinations(rest, size):
                out[f] += weight * (total({*some, f}) - total(set(some)))
    return total(set()), out


def test_contributions_are_shapley_values(spark):
    rng = random.Random(4)
    nodes = random_trees(rng) + [(6, 0, -1, 0.0, -1, -1, 0.3, 1.0, 9.0)]
    assert any(left >= 0 and cover == 0 for *_, left, _, _, _, cover in nodes)
    rows = [(i, [rng.choice([0.0, 0.25, 0.5, 0.6, 1.0, float("nan")]) for _ in range(5)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, features array<double>")
    table = spark.createDataFrame(nodes, ensembles.NODE_SCHEMA)
    got = ensembles.score_nodes(df, table, contributions=True, width=5)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString().replace("AQEShuffle", "")
    xs = dict(rows)
    for r in got.collect():
        bias, want = subset_shapley(nodes, xs[r["id"]], 5)
        assert r["bias"] == pytest.approx(bias, abs=1e-12)
        assert r["contributions"] == pytest.approx(want, abs=1e-12)
        assert r["bias"] + sum(r["contributions"]) == pytest.approx(r["margin"], abs=1e-12)
    assert ensembles.score_nodes(df.where("id < 0"), table, contributions=True, width=5).count() == 0


def test_cross_validation_and_skip(spark):
    df = matrix(spark, 150)
    folds, summary = learning.cross_validate(df, 2, maxIter=2, maxDepth=2, minInstancesPerNode=5)
    assert folds.count() == 2 and summary.first()["folds"] == 2
    assert learning.cross_validate(df.where("label = 0")) is None
    assert learning.usable_folds(3, 5) == 3 and learning.usable_folds(1, 5) == 0


def test_patience():
    assert learning.best_round([0.7, 0.6, 0.5, 0.55, 0.54]) == 3
    assert learning.best_round([0.7, 0.5, 0.6, 0.6, 0.4], patience=2) == 2
    assert learning.best_round([0.7, 0.5, 0.6, 0.6, 0.4], patience=3) == 5
    assert learning.best_round([0.5, 0.5]) == 1


def test_boosting_is_cut_at_the_best_round(spark):
    df = matrix(spark, 300).withColumn("part", F.crc32("domain") % 3)
    train, held = df.where("part > 0"), df.where("part = 0")
    few = dict(maxIter=6, maxDepth=3, minInstancesPerNode=5)
    nodes, rounds, losses = learning.train_with_patience(train, held, patience=2, **few)
    assert len(losses) == 6 and rounds == learning.best_round(losses, 2)
    assert nodes.select("tree").distinct().count() == rounds

    def loss(table, rows):
        p, y = F.col("score"), F.col("label")
        return ensembles.score_nodes(rows, table).agg(F.avg(-F.log(F.when(y == 1, p).otherwise(1 - p)))).first()[0]

    assert 2 * loss(nodes, held) == pytest.approx(losses[rounds - 1], abs=1e-9)
    new = learning.model_nodes(learning.train_gbt(train, maxIter=3, maxDepth=2, minInstancesPerNode=5), spark)
    staged = learning.staged_losses(ensembles.score_nodes(held, nodes), new)
    for i in range(3):
        both = nodes.unionByName(new.where(F.col("tree") <= i).withColumn("tree", F.col("tree") + 100))
        assert staged[i] == pytest.approx(loss(both, held), abs=1e-9)
    longer = learning.finetune(train, nodes, rounds=4, learning_rate=0.2, depth=3, held=held, patience=1)
    assert rounds < longer.select("tree").distinct().count() <= rounds + 4
    table, n = learning.train_validated(train, 2, patience=2, **few)
    assert 1 <= n <= 6 and table.select("tree").distinct().count() == n
    with pytest.raises(ValueError):
        learning.finetune(train, nodes.withColumn("feature", F.lit(48)), rounds=1)


def test_exact_split_counts(spark):
    df = matrix(spark)
    parts = learning.stratified_split(df, exact=True)
    counts = {(r["label"], r["is_test"]): r["n"] for r in parts.groupBy("label", "is_test").agg(F.count("*").alias("n")).collect()}
    for label in (0, 1):
        total = counts[label, True] + counts[label, False]
        assert counts[label, True] == round(total * 0.2)


def test_exact_split_ranks_few_rows(spark, monkeypatch):
    """Against a full ranking; with a hash of few values ties are many and still split by key."""
    rows = [(f"d{i}", i % 3 if i % 50 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "domain string, label int")
    for bits in (None, 3):
        if bits:
            plain = learning.hash_fraction
            monkeypatch.setattr(learning, "hash_fraction", lambda seed, c: F.floor(plain(seed, c) * 2**bits) / 2**bits)
        got = learning.exact_split(df, 0.3, "s")
        by = Window.partitionBy("label").orderBy(learning.hash_fraction("s", F.col("domain")), "domain")
        want = df.withColumn("is_test", F.row_number().over(by) <= F.round(F.count("*").over(Window.partitionBy("label")) * 0.3))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert not any(r["is_test"] for r in learning.exact_split(df, 0.0, "s").collect())


def test_oversampling_does_not_depend_on_ranges_or_blocks(spark, monkeypatch):
    """The same synthetic rows for one range and many, and every neighbour within reach is met."""
    rng = random.Random(3)
    rows = [(f"p{i}", 1, rng.random(), rng.random(), rng.choice("xyz")) for i in range(300)] + [(f"n{i}", 0, 5.0, 5.0, "x") for i in range(4000)]
    df = spark.createDataFrame(rows, "domain string, label int, a double, b double, tld string")
    made = []
    for rows_a_range, block in ((10**6, 10**6), (150, 100), (400, 33)):
        monkeypatch.setattr(learning, "ROWS_PER_RANGE", rows_a_range)
        monkeypatch.setattr(learning, "BLOCK_ROWS", block)
        out = learning.oversample(df, continuous=["a", "b"], categorical=["tld"], reach=16).where("synthetic")
        made.append(sorted(map(str, out.collect())))
    assert made[0] == made[1] == made[2] and len(made[0]) == 1700


@pytest.mark.parametrize("reach", [64, 4])
def test_oversampling_stays_between_neighbours(spark, reach):
    rows = [(f"p{i}", 1, float(i % 40), float(i % 7), "xyz" if i % 3 else "top") for i in range(60)]
    rows += [(f"n{i}", 0, -5.0, -5.0, "com") for i in range(1000)]
    df = spark.createDataFrame(rows, "domain string, label int, a double, b double, tld string")
    out = learning.oversample(df, continuous=["a", "b"], categorical=["tld"], reach=reach)
    made = out.where("synthetic").collect()
    assert len(made) == 440 and out.count() == 1500
    assert all(r["label"] == 1 and 0 <= r["a"] <= 39 and 0 <= r["b"] <= 6 and r["tld"] in ("xyz", "top") for r in made)
    assert learning.oversample(df, "none", continuous=["a", "b"], categorical=["tld"]).count() == 1060


def test_oversampling_uses_one_method_at_any_size(spark):
    """Two clusters: every synthetic row lies between two rows of its own cluster, below and above any size."""
    for n in (40, 3000):
        rows = [(f"p{i}", 1, (i % 2) * 100.0 + i % 10, float(i % 7), "xyz" if i % 2 else "top") for i in range(n)]
        rows += [(f"n{i}", 0, -5.0, -5.0, "com") for i in range(20 * n)]
        df = spark.createDataFrame(rows, "domain string, label int, a double, b double, tld string")
        made = learning.oversample(df, continuous=["a", "b"], categorical=["tld"]).where("synthetic").collect()
        assert len(made) == 10 * n - n
        assert all((r["tld"] == "xyz") == (r["a"] >= 100) and (0 <= r["a"] <= 9 or 100 <= r["a"] <= 109) for r in made)


def counted(spark, rows, schema):
    """The rows, and a counter of how often one of them was computed."""
    seen = spark.sparkContext.accumulator(0)

    def same(x):
        seen.add(1)
        return x

    return spark.createDataFrame(rows, schema).withColumn("score", F.udf(same, "double")("score")), seen


def test_oversampling_and_exact_split_compute_their_input_once(spark):
    rows = [(f"k{i}", float(i % 50) / 50, i % 5, "ab"[i % 2], int(i % 20 == 0)) for i in range(600)]
    schema = "domain string, score double, fold int, kind string, label int"
    df, seen = counted(spark, rows, schema)
    made = learning.oversample(df, continuous=["score", "fold"], categorical=["kind"])
    got = {(r["label"], r["synthetic"]): r["n"] for r in made.groupBy("label", "synthetic").agg(F.count("*").alias("n"), F.sum("score")).collect()}
    assert got == {(0, False): 570, (1, False): 30, (1, True): 255} and seen.value == 600
    df, seen = counted(spark, rows, schema)
    split = learning.exact_split(df, 0.2, "s")
    assert split.agg(F.count_if("is_test"), F.sum("score")).first()[0] == 120 and seen.value == 600
