"""Toxicity by a chain of linear classifiers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.words import ALNUM, Words, sliced, unit_hashes, words
from wardlight.session import scratch_path

#: Labelled rows of each class of the last category that the models are fitted on, at most.
SAMPLE = 10_000
#: Features kept: those most associated with a category.
FEATURES = 1_000
#: Least chi-squared value and least number of documents of a feature.
LEAST_CHI, LEAST_DOCS = 15.0, 4
FOLDS = 3
ITERATIONS, PENALTY = 40, 1e-4
#: Bytes of the word heads that are features besides the words.
HEADS = (4, 5, 6)


class Chain(NamedTuple):
    """``weights[c]`` are the features' and then the earlier categories' weights."""

    categories: list[str]
    features: np.ndarray
    weights: np.ndarray
    intercepts: np.ndarray
    threshold: float


def _features(found: Words, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature): a text's words and the heads of longer ones."""
    row = np.repeat(np.arange(rows), found.per_row)
    at, features = [row], [found.hashes]
    for size in HEADS:
        long = found.length > size
        start = found.start[long]
        inside = np.zeros(len(found.data), bool)
        for k in range(size):
            inside[start + k] = True
        heads = unit_hashes(found.data, inside, start, np.full(len(start), size))
        at.append(row[long])
        features.append(heads * np.uint64(0xD1342543DE82EF95) + np.uint64(size))
    return np.concatenate(at), np.concatenate(features)


def _once(row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((feature, row))
    row, feature = row[order], feature[order]
    if not len(row):
        return row, feature
    new = np.r_[True, (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])]
    return row[new], feature[new]


def _index(features: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``asked`` that are known features, their numbers); ``features`` ascend."""
    if not len(features):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    likely = np.zeros(1 << 16, bool)
    likely[(features >> np.uint64(48)).astype(np.int64)] = True
    at = np.flatnonzero(likely[(asked >> np.uint64(48)).astype(np.int64)])
    number = np.minimum(np.searchsorted(features, asked[at]), len(features) - 1)
    hit = features[number] == asked[at]
    return at[hit], number[hit]


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: list[str], key: str, text: str,
                    most: int = SAMPLE) -> DataFrame:
    """(key, text, y) of at most about ``most`` labelled rows of each class of the last category.

    Rows are taken by a hash of their key, so the sample is the same in every run.  Its
    keys are broadcast: their number is bounded by ``most``.
    """
    y = F.array(*(F.coalesce(F.col(c), F.lit(0)).cast("double") for c in categories))
    rows = labels.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), y.alias("y")).dropDuplicates(["key"])
    last = F.get("y", F.lit(len(categories) - 1))
    sizes = {r["c"]: r["n"] for r in rows.groupBy(last.alias("c")).agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for c, n in sizes.items():
        share = F.when(last == c, F.lit(min(1.0, most / n))).otherwise(share)
    place = F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1_000_000)) / 1_000_000.0
    taken = rows.where(place < share)
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where(
        F.col("text").isNotNull()).join(F.broadcast(taken), "key")


def associated(sample: DataFrame, categories: list[str], most: int = FEATURES) -> np.ndarray:
    """The features with the greatest chi-squared value for some category, ascending."""
    k = len(categories)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n = batch.num_rows
            row, feature = _once(*_features(words(batch["text"], ALNUM), n))
            y = np.array(batch["y"].to_pylist(), float).reshape(n, k)
            distinct, code = np.unique(feature, return_inverse=True)
            docs = np.bincount(code, minlength=len(distinct)).astype(float)
            hits = [np.bincount(code, weights=y[row, c], minlength=len(distinct)) for c in range(k)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(distinct.view(np.int64)), pa.array(docs), *map(pa.array, hits)],
                ["feature", "n", *(f"h{c}" for c in range(k))])

    sums = [F.sum(f"h{c}").alias(f"h{c}") for c in range(k)]
    counted = sample.mapInArrow(count, "feature long, n double, " + ", ".join(f"h{c} double" for c in range(k))).groupBy(
        "feature").agg(F.sum("n").alias("n"), *sums).where(F.col("n") >= LEAST_DOCS)
    total = sample.agg(F.count("*").cast("double").alias("n"), *(
        F.sum(F.get("y", F.lit(c))).alias(f"h{c}") for c in range(k))).first()
    n = total["n"]
    chi = F.lit(0.0)
    for c in range(k):
        pos = total[f"h{c}"] or 0.0
        if 0 < pos < n:
            a, m = F.col(f"h{c}"), F.col("n")
            value = n * F.pow(a * (n - pos) - (m - a) * pos, F.lit(2)) / (pos * (n - pos) * m * F.greatest(n - m, F.lit(0.5)))
            chi = F.greatest(chi, value)
    best = counted.select("feature", chi.alias("chi")).where(F.col("chi") >= LEAST_CHI).orderBy(
        F.desc("chi"), "feature").limit(most)
    return np.sort(np.array([r["feature"] for r in best.collect()], np.int64).view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], key: str = "doc_id", text: str = "text",
        most: int = SAMPLE) -> Chain:
    """The chain over ``categories`` (0/1 columns of ``labels``), in that order.

    The model of a category reads the features and the probabilities of the categories
    before it.  In training those probabilities are out-of-fold: of each fold's rows by
    a model that was fitted on the other folds, so a later model learns what an earlier
    one is worth on rows it hasn't seen.  The threshold on the last category is the one
    of best F1 on its own out-of-fold probabilities, the middle of a tie.

    Without labels, or with one class only, the last category is never predicted.
    """
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, categories, key, text, most)
    features = associated(sample, categories)
    given = spark.sparkContext.broadcast(features)
    d, k = len(features), len(categories)

    def dense(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            row, feature = _features(words(batch["text"], ALNUM), batch.num_rows)
            at, number = _index(given.value, feature)
            pairs = np.unique(row[at] * max(d, 1) + number)
            ends = np.searchsorted(pairs // max(d, 1), np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [batch["key"], batch["y"], pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                                                    pa.array(pairs % max(d, 1), pa.int32()))],
                ["key", "y", "x"])

    kind = docs.schema[key].dataType.simpleString()
    # written by the scan's own tasks; what is read back is the bounded sample
    rows = _kept(sample.mapInArrow(dense, f"key {kind}, y array<double>, x array<int>")).coalesce(4)
    names = [str(i) for i in range(max(d, 1))]
    counter = CountVectorizerModel.from_vocabulary(names, inputCol="w", outputCol="bag").setBinary(True).setMinTF(1.0)
    rows = _kept(counter.transform(rows.withColumn("w", F.col("x").cast("array<string>"))).select(
        "key", "y", F.pmod(F.xxhash64("key", F.lit(5)), F.lit(FOLDS)).alias("fold"), "bag"))
    weights, intercepts = np.zeros((k, max(d, 1) + k)), np.full(k, -40.0)
    threshold = 1.0
    for c in range(k):
        join = VectorAssembler(inputCols=["bag", *(f"p{i}" for i in range(c))], outputCol="features")
        data = join.transform(rows).withColumn("label", F.get("y", F.lit(c)))
        classes = {r["label"] for r in data.select("label").distinct().collect()}
        if classes != {0.0, 1.0} or not d:
            intercepts[c] = 40.0 if classes == {1.0} else -40.0
            rows = rows.withColumn(f"p{c}", F.lit(float(classes == {1.0})))
            continue
        model = LogisticRegression(maxIter=ITERATIONS, regParam=PENALTY, standardization=False)
        whole = model.fit(data)
        weights[c, :max(d, 1) + c], intercepts[c] = whole.coefficients.toArray(), whole.intercept
        parts = None
        for f in range(FOLDS):
            held, others = data.where(F.col("fold") == f), data.where(F.col("fold") != f)
            both = others.select("label").distinct().count() == 2
            part = (model.fit(others) if both else whole).transform(held).select(
                *rows.columns, F.get(vector_to_array("probability"), F.lit(1)).alias(f"p{c}"))
            parts = part if parts is None else parts.unionByName(part)
        rows = _kept(parts)
        if c == k - 1:
            threshold = _best_threshold(rows, c)
    return Chain(categories, features, weights, intercepts, threshold)


def _kept(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared folder and read back."""
    path = scratch_path(rows.sparkSession, "sample")
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _best_threshold(rows: DataFrame, c: int) -> float:
    """The cut of best F1 over 200 steps of the out-of-fold probability."""
    got = rows.groupBy(F.floor(F.col(f"p{c}") * 200).alias("b")).agg(
        F.sum(F.get("y", F.lit(c))).alias("pos"), F.count("*").alias("n")).collect()
    pos, n = np.zeros(202), np.zeros(202)
    for r in got:
        pos[int(r["b"])] += r["pos"]
        n[int(r["b"])] += r["n"]
    right, found = np.cumsum(pos[::-1])[::-1], np.cumsum(n[::-1])[::-1]
    f1 = 2 * right / np.maximum(found + pos.sum(), 1)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(best[len(best) // 2]) / 200


def predict(docs: DataFrame, chain: Chain, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, p_<category> ..., toxic) for each row of ``docs``; ``toxic`` cuts the last category.

    Null and empty texts have no features; a null key stays null; repeated rows repeat;
    other columns are not read.  Map-only; the model sent to tasks is at most
    ``FEATURES`` numbers a category.
    """
    given = docs.sparkSession.sparkContext.broadcast(tuple(chain))
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Chain(*given.value)
        d = max(len(model.features), 1)
        for batch in sliced(batches):
            n = batch.num_rows
            row, feature = _features(words(batch["text"], ALNUM), n)
            at, number = _index(model.features, feature)
            pairs = np.unique(row[at] * d + number)
            earlier = np.zeros((n, len(names)))
            for c in range(len(names)):
                margin = np.bincount(pairs // d, weights=model.weights[c, pairs % d], minlength=n) + model.intercepts[c]
                margin += earlier[:, :c] @ model.weights[c, d:d + c]
                earlier[:, c] = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [batch["key"], *(pa.array(earlier[:, c]) for c in range(len(names))),
                 pa.array(earlier[:, -1] >= model.threshold)], ["key", *names, "toxic"])

    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
            .mapInArrow(run, f"key {kind}, " + ", ".join(f"{x} double" for x in names) + ", toxic boolean")
            .withColumnRenamed("key", key))
