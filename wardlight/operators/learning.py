"""Splits, class balance, gradient boosting and continued training."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardlight.functions.scores import hash_fraction
from wardlight.operators.ensembles import score_nodes, sigmoid, staged_margins
from wardlight.operators.metrics import cv_summary, evaluate
from wardlight.schemas import CATEGORICAL_FEATURES, CONTINUOUS_FEATURES, FEATURE_NAMES
from wardlight.session import checkpoint, scratch_path, written

TEST_SHARE, VALIDATION_SHARE = 0.2, 0.1
IMBALANCE, MINORITY_RATIO, NEIGHBOURS = 0.10, 0.5, 5
#: Rounds without a lower validation loss before boosting is cut.
PATIENCE = 50
#: Rounds of a first fit, which is done anew with twice as many while patience lasts.
FIRST_ROUNDS = 100
TABLES, REACH, ROWS_PER_RANGE = 8, 32, 100_000
#: Places of an order that one task compares.
BLOCK_ROWS = 20_000
#: Bits of the hash that splits go by, and of it that are counted at once.
HASH_BITS, DIGIT_BITS = 32, 8


# --- splits --------------------------------------------------------------------

def hash_split(df: DataFrame, share: float, seed: str, key: str = "domain", out: str = "is_test") -> DataFrame:
    """Marks about ``share`` of every class by a hash of the key: map-only."""
    return df.withColumn(out, hash_fraction(seed, F.col(key)) < share)


def exact_split(df: DataFrame, share: float, seed: str, key: str = "domain", label: str = "label",
                out: str = "is_test") -> DataFrame:
    """Marks exactly round(share * n) rows per class (keys must be unique).

    Radix selection of the cut: rows are counted by the leading ``DIGIT_BITS`` of their
    32-bit hash, then inside the digit that holds the cut by the next ones, down to one
    hash value.  Only the rows of that value are ranked, about one in 2^32 of the class.
    """
    # written once: the cut takes a pass a digit
    work = written(df.withColumn("_h", F.floor(hash_fraction(seed, F.col(key)) * 2**HASH_BITS)), "split")
    wanted = F.round(F.count("*") * share).alias("_need")
    cut = df.groupBy(F.col(label).alias("_label")).agg(wanted).where("_need > 0").withColumn("_value", F.lit(0).cast("long"))
    for shift in range(HASH_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
        # ``_value``: the digits before this one, at first none
        inside = work.join(cut, work[label].eqNullSafe(F.col("_label"))).where(
            F.shiftright("_h", shift + DIGIT_BITS) == F.col("_value"))
        counts = inside.groupBy("_label", F.shiftright("_h", shift).alias("_digit")).agg(F.count("*").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy("_label").orderBy("_digit"))
        need = cut.select(F.col("_label").alias("_class"), "_need")
        cut = (counts.withColumn("_upto", upto).join(need, F.col("_label").eqNullSafe(F.col("_class")))
               .where((F.col("_upto") - F.col("_n") < F.col("_need")) & (F.col("_need") <= F.col("_upto")))
               .select("_label", (F.col("_need") - F.col("_upto") + F.col("_n")).alias("_need"), F.col("_digit").alias("_value")))
        cut = checkpoint(cut)
    ranked = work.join(cut, work[label].eqNullSafe(F.col("_label")) & (F.col("_h") == F.col("_value"))).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_label").orderBy(key)))
    last = ranked.where(F.col("_rank") == F.col("_need")).select("_label", F.struct("_h", F.col(key).alias("_k")).alias("_last"))
    marked = work.join(last, work[label].eqNullSafe(F.col("_label")), "left")
    inside = F.coalesce(F.struct("_h", F.col(key).alias("_k")) <= F.col("_last"), F.lit(False))
    return marked.withColumn(out, inside).drop("_h", "_label", "_last")


def stratified_split(df: DataFrame, seed: str = "42", exact: bool = False, **kw) -> DataFrame:
    return (exact_split if exact else hash_split)(df, TEST_SHARE, f"test-{seed}", **kw)


def validation_split(train: DataFrame, seed: str = "42", **kw) -> DataFrame:
    return hash_split(train, VALIDATION_SHARE, f"validation-{seed}", out="is_validation", **kw)


def usable_folds(smallest_class: int, folds: int) -> int:
    """Folds clamped so each keeps both classes; 0 means skip."""
    return 0 if smallest_class < 2 else max(2, min(folds, smallest_class))


def kfold(df: DataFrame, folds: int = 5, seed: str = "42", key: str = "domain") -> DataFrame:
    return df.withColumn("fold", F.floor(hash_fraction(f"fold-{seed}", F.col(key)) * folds).cast("int"))


# --- class balance ---------------------------------------------------------------

def class_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Positive rows weigh negatives / positives, negative rows 1."""
    ratio = df.agg(F.try_divide(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1))).scalar()
    return df.withColumn(out, F.when(F.col(label) == 1, ratio).otherwise(F.lit(1.0)))


def oversample_plan(df: DataFrame, mode: str = "auto", threshold: float = IMBALANCE,
                    ratio: float = MINORITY_RATIO, label: str = "label") -> DataFrame:
    """One row: class sizes, whether to resample, neighbours and rows to add."""
    if mode not in ("auto", "smote", "none"):
        raise ValueError(f"mode must be auto, smote or none, not {mode}")
    zero, one = (F.count_if(F.col(label) == v) for v in (0, 1))
    sizes = df.agg(F.least(zero, one).alias("n_minority"), F.greatest(zero, one).alias("n_majority"),
                   F.when(one <= zero, 1).otherwise(0).alias("minority_label"))
    n, m = F.col("n_minority"), F.col("n_majority")
    share = F.coalesce(F.try_divide(n, n + m), F.lit(0.0))
    missing = (m * ratio - n).cast("long")
    allowed = {"none": F.lit(False), "smote": F.lit(True), "auto": share < threshold}[mode]
    resample = allowed & (n >= 2) & (missing > 0)
    return sizes.withColumns({
        "minority_fraction": share, "resample": resample,
        "k_neighbors": F.least(F.lit(NEIGHBOURS).cast("long"), n - 1),
        "n_new": F.when(resample, missing).otherwise(F.lit(0).cast("long"))})


def oversample(df: DataFrame, mode: str = "auto", key: str = "domain", label: str = "label", seed: int = 42,
               continuous: list[str] = CONTINUOUS_FEATURES, categorical: list[str] = CATEGORICAL_FEATURES,
               tables: int = TABLES, reach: int = REACH, **rule) -> DataFrame:
    """Adds interpolated minority rows (``synthetic`` marks them); keys must be unique.

    A row's neighbours are the nearest of those within ``reach`` places of it in any of
    ``tables`` orders, each by a random projection of all continuous features; up to
    ``reach`` + 1 minority rows that is an exact search.  The method is the same for any
    number of rows, and the rows made don't depend on how the orders are cut for tasks.
    """
    df = written(df, "oversample")  # read for the sizes, the rare class and the result
    plan = oversample_plan(df, mode, label=label, **rule).first()
    real = df.withColumn("synthetic", F.lit(False))
    if not plan["resample"]:
        return real
    minority = df.where(F.col(label) == plan["minority_label"])
    stats = minority.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in continuous]).first()
    spread = [stats[c] or 0.0 for c in continuous]
    penalty = float(np.median(spread)) ** 2
    base, extra = divmod(plan["n_new"], plan["n_minority"])
    first = exact_split(minority, extra / plan["n_minority"], f"extra-{seed}", key, label, "_more")
    rows = first.withColumn("_copies", F.lit(base) + F.col("_more").cast("int"))
    k = int(plan["k_neighbors"])
    near = _nearest(rows, key, continuous, categorical, spread, penalty, k, seed, tables, reach, plan["n_minority"])
    # at most k of each order: a short list a row
    best = F.slice(F.array_sort(F.collect_set(F.struct("gap", "other", "other_x", "other_cats"))), 1, k)
    lists = near.groupBy("key", "x", "copies").agg(best.alias("near")).select(
        "key", "x", "copies", F.flatten("near.other_x").alias("near_x"), F.flatten("near.other_cats").alias("near_cats"))
    made = lists.mapInPandas(_synthesizer(len(categorical), seed), "key string, number int, x array<double>, cats array<string>")
    fixed = {c: F.get("x", F.lit(i)) for i, c in enumerate(continuous)} | {
        c: F.get("cats", F.lit(i)) for i, c in enumerate(categorical)}
    kinds = dict(df.dtypes)
    fixed |= {key: F.concat_ws("#", "key", "number") if kinds[key] == "string" else F.col("key"),
              label: F.lit(plan["minority_label"])}
    columns = [fixed.get(c, F.lit(None)).cast("double" if c in continuous else kinds[c]).alias(c) for c in df.columns]
    real = real.withColumns({c: F.col(c).cast("double") for c in continuous})
    return real.unionByName(made.select(*columns).withColumn("synthetic", F.lit(True)))


def _placed(rows: DataFrame, tables: int, n_rows: int) -> DataFrame:
    """``rows`` (table, place, key, ...) with ``rank``, their number in the order of (table, place, key).

    Ranges are sorted apart and numbered from the counts of those before them, so ranks
    don't depend on how many ranges there are.
    """
    ranges = max(1, -(-n_rows * tables // ROWS_PER_RANGE))
    path = scratch_path(rows.sparkSession, "places")
    (rows.repartitionByRange(ranges, "table", "place", "key").sortWithinPartitions("table", "place", "key")
     .withColumn("_at", F.monotonically_increasing_id()).write.parquet(path))
    written = rows.sparkSession.read.parquet(path)
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = written.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row a range
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (written.withColumn("_part", part).join(firsts, "_part")
            .withColumn("rank", F.col("_before") + inside).drop("_at", "_part", "_before"))


def _nearest(rows, key, continuous, categorical, spread, penalty, k, seed, tables, reach, n_rows) -> DataFrame:
    """(key, other, gap, x, other_x, other_cats, copies): near rows of each row that is copied.

    The order of each projection is cut into blocks of ``BLOCK_ROWS`` places; a block's
    task also gets the ``reach`` rows on both sides of it, so no row lacks neighbours.
    """
    scale = np.array([1 / s if s else 0.0 for s in spread])
    ways = np.random.default_rng(seed).standard_normal((tables, len(continuous))) * scale

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"].to_numpy())
                for t in range(tables):
                    yield pdf.assign(table=t, place=x @ ways[t])

    def lists(rows: np.ndarray) -> pd.Series:
        return pd.Series(list(rows), dtype=object)  # also where there are none

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("rank")
        found = []
        for _, pdf in block.groupby("table"):
            n = len(pdf)
            x, cats = np.stack(pdf["x"].to_numpy()), np.stack(pdf["cats"].to_numpy())
            gaps = np.full((n, 2 * reach), np.inf)
            for o in range(1, min(reach, n - 1) + 1):
                gap = ((x[o:] - x[:-o]) ** 2).sum(1) + penalty * (cats[o:] != cats[:-o]).sum(1)
                gaps[:-o, o - 1] = gap
                gaps[o:, reach + o - 1] = gap
            asks = (pdf["_copies"].to_numpy() > 0) & pdf["own"].to_numpy()
            best = np.argsort(gaps, axis=1, kind="stable")[:, :k]
            i, j = np.nonzero(np.isfinite(np.take_along_axis(gaps, best, 1)) & asks[:, None])
            step = best[i, j]
            other = i + np.where(step < reach, step + 1, reach - step - 1)
            found.append(pd.DataFrame({
                "key": pdf["key"].to_numpy()[i], "other": pdf["key"].to_numpy()[other], "gap": gaps[i, step],
                "x": lists(x[i]), "other_x": lists(x[other]), "other_cats": lists(cats[other]), "copies": pdf["_copies"].to_numpy()[i]}))
        return pd.concat(found, ignore_index=True)

    shape = "key string, x array<double>, cats array<string>, _copies long"
    slim = rows.select(
        F.col(key).cast("string").alias("key"), F.array(*[F.col(c).cast("double") for c in continuous]).alias("x"),
        F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in categorical]).cast("array<string>").alias("cats"),
        F.col("_copies").cast("long").alias("_copies"))
    # the rare class is small in bytes, the projection is not: as many tasks as ranges
    slim = slim.repartition(max(1, -(-n_rows * tables // ROWS_PER_RANGE)))
    placed = _placed(slim.mapInPandas(project, f"{shape}, table int, place double"), tables, n_rows)
    block = lambda r: F.floor(r / BLOCK_ROWS)
    rank = F.col("rank")
    dealt = placed.withColumn("block", F.explode(F.array_distinct(F.array(block(rank), block(rank - reach), block(rank + reach)))))
    return dealt.withColumn("own", F.col("block") == block(rank)).groupBy("block").applyInPandas(
        compare, "key string, other string, gap double, x array<double>, other_x array<double>, other_cats array<string>, copies long")


def _synthesizer(n_categorical: int, seed: int):
    """The copies of each row from its list of near rows, a batch at a time."""
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, numbers, made, modes = [], [], [], []
            for key, own, n, near, cats in zip(pdf["key"], pdf["x"], pdf["copies"], pdf["near_x"], pdf["near_cats"]):
                n, own = int(n), np.asarray(own)
                rng = np.random.default_rng([seed, zlib.crc32(key.encode())])
                others = np.asarray(near).reshape(-1, len(own))
                made.append(own + rng.random(n)[:, None] * (others[rng.integers(len(others), size=n)] - own))
                most = []
                for c in range(n_categorical):
                    names = Counter(cats[c::n_categorical])
                    most.append(min(names, key=lambda v: (-names[v], v)))
                keys += [key] * n
                numbers += range(n)
                modes += [most] * n
            if keys:
                yield pd.DataFrame({"key": keys, "number": np.array(numbers, dtype=np.int32), "x": list(np.concatenate(made)), "cats": modes})

    return make


# --- boosting --------------------------------------------------------------------

# The published training recipe.
RECIPE = dict(stepSize=0.05, maxIter=1000, maxDepth=5, subsamplingRate=0.8,
              featureSubsetStrategy="0.8", minInstancesPerNode=20)


def with_vector(df: DataFrame, features: str = "features") -> DataFrame:
    return df.withColumn("vector", array_to_vector(F.col(features)))


def train_gbt(df: DataFrame, label: str = "label", weight: str | None = None, seed: int = 42, **params):
    """Gradient-boosted trees on the ``features`` array, all rounds (see ``train_with_patience``)."""
    options = {**RECIPE, **params}
    gbt = GBTClassifier(featuresCol="vector", labelCol="_y", seed=seed, **options)
    if weight:
        gbt = gbt.setWeightCol(weight)
    return gbt.fit(with_vector(df).withColumn("_y", F.col(label).cast("double")))


def model_nodes(model, spark, first_tree: int = 0, tree_scale: float = 2.0) -> DataFrame:
    """A fitted tree ensemble as a node table.

    A boosted classifier's probability is sigmoid(2 * margin), so by default its weights
    are doubled and ``sigmoid`` of the table's margin is that probability.
    """
    path = scratch_path(spark, "model")
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    data = data.select(F.col("treeID").alias("tree"), "nodeData.*")
    pairs = F.create_map(*[F.lit(x) for i, w in enumerate(model.treeWeights) for x in (i, tree_scale * w)])
    weight = F.element_at(pairs, F.col("tree"))
    inner = F.col("leftChild") >= 0
    return data.select(
        (F.col("tree") + first_tree).cast("int").alias("tree"), F.col("id").cast("int").alias("node"),
        F.when(inner, F.col("split.featureIndex")).otherwise(-1).cast("int").alias("feature"),
        F.when(inner, F.get("split.leftCategoriesOrThreshold", F.lit(0))).otherwise(0.0).alias("threshold"),
        F.col("leftChild").cast("int").alias("left"), F.col("rightChild").cast("int").alias("right"),
        F.col("prediction").alias("value"), weight.alias("weight"), F.col("rawCount").cast("double").alias("cover"))


def best_round(losses: list[float], patience: int = PATIENCE) -> int:
    """Number of rounds up to the lowest validation loss, looking on until ``patience`` rounds bring none lower."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def train_with_patience(train: DataFrame, held: DataFrame, label: str = "label", patience: int = PATIENCE,
                        weight: str | None = None, seed: int = 42, first: int = FIRST_ROUNDS,
                        **params) -> tuple[DataFrame, int, list[float]]:
    """(node table cut at the best round, rounds kept, loss of each round fitted on ``held``).

    ``held`` takes no part in the fit; its log loss after every round comes from one pass.
    Later rounds don't change earlier ones, so cutting is the same as stopping there, and
    those after patience has run out needn't be fitted.  MLlib can't go on from a model: a
    fit of ``first`` rounds that don't suffice is done anew with twice as many, up to ``maxIter``.
    """
    if weight:
        held = held.withColumn(weight, F.lit(1.0))
    held = with_vector(held).withColumn("_y", F.col(label).cast("double"))
    most = {**RECIPE, **params}["maxIter"]
    fitted = min(first, most)
    while True:
        model = train_gbt(train, label, weight=weight, seed=seed, **{**params, "maxIter": fitted})
        losses = model.evaluateEachIteration(held)
        rounds = best_round(losses, patience)
        if fitted == most or rounds + patience <= fitted:
            break
        fitted = min(2 * fitted, most)
    return model_nodes(model, train.sparkSession).where(F.col("tree") < rounds), rounds, losses


def cross_validate(df: DataFrame, folds: int = 5, label: str = "label", seed: int = 42, key: str = "domain",
                   patience: int = PATIENCE, **params) -> tuple[DataFrame, DataFrame] | None:
    """(metrics and best round per fold, their summary); None when a class is too small.

    A fold's rows choose the best round of the model that is fitted without them; the
    summary's ``best_round`` is the rounded mean, for the final fit.
    """
    spark = df.sparkSession
    sizes = df.groupBy(label).count().collect()
    smallest = min(r["count"] for r in sizes) if len(sizes) > 1 else 0
    k = usable_folds(smallest, folds)
    if not k:
        return None
    rows = checkpoint(kfold(df, k, str(seed), key))
    scored, kept, enough = None, [], FIRST_ROUNDS
    for i in range(k):
        held = rows.where(F.col("fold") == i)
        nodes, rounds, losses = train_with_patience(
            rows.where(F.col("fold") != i), held, label, patience, seed=seed, first=enough, **params)
        kept.append((i, rounds))
        enough = max(enough, len(losses))  # what sufficed for a fold is what the next one begins with
        # scored once, fold by fold: the metrics read the scores several times
        part = written(score_nodes(held, nodes).select("fold", F.col(label).cast("int").alias("y"), "score"), "scores")
        scored = part if scored is None else scored.unionByName(part)
    rounds = spark.createDataFrame(kept, "fold int, best_round int")
    metrics = checkpoint(evaluate(scored, by=["fold"]).join(rounds, "fold"))
    mean = round(sum(n for _, n in kept) / k)
    return metrics, cv_summary(metrics).withColumn("best_round", F.lit(mean))


def train_validated(train: DataFrame, folds: int = 5, label: str = "label", seed: int = 42, key: str = "domain",
                    patience: int = PATIENCE, **params) -> tuple[DataFrame, int]:
    """(node table, rounds): all of ``train`` fitted for the folds' mean best round.

    Where a class is too small for folds, the recipe's number of rounds stands.
    """
    done = cross_validate(train, folds, label, seed, key, patience, **params)
    rounds = done[1].first()["best_round"] if done else {**RECIPE, **params}["maxIter"]
    return model_nodes(train_gbt(train, label, seed=seed, **{**params, "maxIter": max(1, rounds)}), train.sparkSession), rounds


def finetune(df: DataFrame, nodes: DataFrame, rounds: int = 500, learning_rate: float = 0.02, depth: int = 5,
             label: str = "label", seed: int = 42, held: DataFrame | None = None, patience: int = PATIENCE,
             **params) -> DataFrame:
    """Continues boosting from an existing node table; returns the longer one.

    One boosted regression of the log loss's gradient at the earlier model's margin: the
    new trees fit what the old ones leave, and their sum is added to the margin.  Four times
    the gradient is at most a Newton step, so the first tree counts whole.  With ``held``
    rows, which take no part in the fit, the new trees are cut at the round after which
    the log loss of both models together is lowest on them.
    """
    known = nodes.agg(F.max("tree").alias("tree"), F.max("feature").alias("feature")).first()
    if known["feature"] >= len(FEATURE_NAMES):
        raise ValueError(f"the earlier model asks for feature {known['feature']}; there are {len(FEATURE_NAMES)}")
    first = known["tree"] + 1
    rows = score_nodes(df, nodes).withColumn("residual", 4.0 * (F.col(label).cast("double") - sigmoid(F.col("margin"))))
    rows = checkpoint(with_vector(rows).select("vector", "residual"))
    gbt = GBTRegressor(featuresCol="vector", labelCol="residual", maxIter=rounds, stepSize=learning_rate, maxDepth=depth,
                       minInstancesPerNode=RECIPE["minInstancesPerNode"], seed=seed, **params)
    new = model_nodes(gbt.fit(rows), df.sparkSession, first_tree=first, tree_scale=1.0)
    if held is not None:
        kept = best_round(staged_losses(score_nodes(held, nodes), new, label), patience)
        new = new.where(F.col("tree") < first + kept)
    return nodes.unionByName(new)


def staged_losses(scored: DataFrame, nodes: DataFrame, label: str = "label") -> list[float]:
    """Mean log loss after each tree of ``nodes`` on top of the column ``margin``; one pass, one number a tree."""
    staged = staged_margins(scored, nodes).select(F.posexplode("staged").alias("round", "m"), F.col(label).cast("double").alias("y"))
    loss = F.log1p(F.exp(-F.abs("m"))) + F.greatest("m", F.lit(0.0)) - F.col("y") * F.col("m")
    return [r["loss"] for r in staged.groupBy("round").agg(F.avg(loss).alias("loss")).orderBy("round").collect()]


def model_card(metrics: DataFrame, version: str | Column, training_samples: int | Column,
               notes: str | None = None) -> DataFrame:
    """Registry rows of trained models from their metrics rows."""
    samples = training_samples if isinstance(training_samples, Column) else F.lit(training_samples)
    return metrics.select(
        (version if isinstance(version, Column) else F.lit(version)).alias("version"), "accuracy", "f1_score", "auc_roc", "precision_score", "recall_score",
        "false_positive_rate", samples.cast("long").alias("training_samples"),
        F.lit(len(FEATURE_NAMES)).alias("feature_count"), F.lit(notes).cast("string").alias("notes"))

