"""Tree ensembles given as data: scoring and per-feature contributions.

An ensemble is a node table (tree, node, feature, threshold, left, right,
value, weight, cover): rows go left when feature <= threshold; ``left`` is -1
at a leaf; ``value`` is the mean prediction at the node; ``cover`` is the
number of training rows that reached it.  Its size is set by the model, not by
the data, and is checked before it is shipped to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions.scores import clamp01, score_to_confidence, score_to_label
from wardlight.operators import shapley
from wardlight.schemas import FEATURE_NAMES

# Default bound on the rows of a model that are shipped to tasks; a parameter where used.
MAX_NODES = 2_000_000
NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int,"
               " value double, weight double, cover double")


def sigmoid(margin: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-margin))


def score_leaf_boxes(df: DataFrame, leaves: DataFrame, base: float = 0.0, max_rows: int = MAX_NODES) -> DataFrame:
    """Adds ``margin`` and ``score`` from leaf boxes.

    ``leaves``: (tree, leaf, feature, low, high, value), one row per bounded
    feature of a leaf; a row falls into the leaf when low <= x < high for all.
    Map-only: Arrow batches against the broadcast boxes, of which there may be
    ``max_rows`` rows (a model's size, not the data's).
    """
    shared = df.sparkSession.sparkContext.broadcast(_boxes(leaves, max_rows))
    names = shared.value["names"]

    def inside(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        box = shared.value
        for batch in batches:
            x = np.stack(batch.to_numpy()).astype(float) if len(batch) else np.zeros((0, len(names)))
            margin = np.full(len(x), base)
            for start, stop, value in zip(box["starts"], box["stops"], box["values"], strict=True):
                live = np.arange(len(x))
                for f, low, high in zip(box["feature"][start:stop], box["low"][start:stop], box["high"][start:stop], strict=True):
                    live = live[(x[live, f] >= low) & (x[live, f] < high)]
                margin[live] += value
            yield pd.Series(margin)

    values = F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(float("nan"))) for n in names]) if names else \
        F.array().cast("array<double>")
    scored = df.withColumn("margin", F.pandas_udf(inside, "double")(values))
    return scored.withColumn("score", sigmoid(F.col("margin")))


def _boxes(leaves: DataFrame, max_rows: int) -> dict:
    rows = leaves.limit(max_rows + 1).toPandas().sort_values(["tree", "leaf", "feature"])
    if len(rows) > max_rows:
        raise ValueError(f"ensemble has more than {max_rows} bounds; raise max_rows if tasks can hold them")
    names = sorted(rows["feature"].unique())
    place = {n: i for i, n in enumerate(names)}
    sizes = rows.groupby(["tree", "leaf"], sort=True).size().to_numpy()
    stops = np.cumsum(sizes)
    return {"names": names, "feature": rows["feature"].map(place).to_numpy(), "low": rows["low"].to_numpy(),
            "high": rows["high"].to_numpy(), "starts": stops - sizes, "stops": stops,
            "values": rows["value"].to_numpy()[stops - sizes] if len(rows) else np.zeros(0)}


def _arrays(nodes: DataFrame, max_nodes: int) -> dict[str, np.ndarray]:
    rows = nodes.limit(max_nodes + 1).toPandas().sort_values(["tree", "node"])
    if len(rows) > max_nodes:
        raise ValueError(f"ensemble has more than {max_nodes} nodes; raise max_nodes if tasks can hold them")
    sizes = rows.groupby("tree").size()
    offset = dict(zip(sizes.index, np.concatenate([[0], np.cumsum(sizes.to_numpy())[:-1]])))
    shift = rows["tree"].map(offset).to_numpy()
    out = {c: rows[c].to_numpy() for c in ("feature", "threshold", "value", "weight", "cover")}
    for side in ("left", "right"):
        child = rows[side].to_numpy()
        out[side] = np.where(child < 0, -1, child + shift)
    out["roots"] = np.array(sorted(offset.values()), dtype=np.int64)
    return out


def _tree_values(x: np.ndarray, model: dict[str, np.ndarray]) -> Iterator[np.ndarray]:
    """What each tree adds to the rows' margins, tree by tree."""
    rows = np.arange(len(x))
    for root in model["roots"]:
        at = np.full(len(x), root)
        while True:
            live = rows[model["left"][at] >= 0]
            if not len(live):
                break
            here = at[live]
            left = x[live, model["feature"][here]] <= model["threshold"][here]
            at[live] = np.where(left, model["left"][here], model["right"][here])
        yield model["weight"][root] * model["value"][at]


def score_nodes(df: DataFrame, nodes: DataFrame, features: str = "features",
                contributions: bool = False, width: int = len(FEATURE_NAMES),
                max_nodes: int = MAX_NODES) -> DataFrame:
    """Adds ``margin`` and ``score`` (and ``bias``, ``contributions``).

    Map-only: Arrow batches against a broadcast node table.  Contributions are the exact
    Shapley values over each tree's paths, ``bias`` is the mean margin over the training
    rows, and bias + sum(contributions) equals the margin.
    """
    model = _arrays(nodes, max_nodes)
    mean, paths = shapley.leaf_paths(model) if contributions else (None, None)
    shared = df.sparkSession.sparkContext.broadcast((model, paths))
    fields = "margin double, bias double, contributions array<double>"

    def walk(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, paths = shared.value
        for batch in batches:
            x = np.stack(batch.to_numpy()) if len(batch) else np.zeros((0, width))
            pushes = [None] * len(x) if paths is None else list(shapley.contributions(x, paths, width))
            yield pd.DataFrame({"margin": sum(_tree_values(x, model), np.zeros(len(x))), "bias": mean, "contributions": pushes})

    scored = df.withColumn("_s", F.pandas_udf(walk, fields)(F.col(features)))
    scored = scored.withColumns({"margin": F.col("_s.margin"), "score": sigmoid(F.col("_s.margin"))})
    if contributions:
        scored = scored.withColumns({"bias": F.col("_s.bias"), "contributions": F.col("_s.contributions")})
    return scored.drop("_s")


def staged_margins(df: DataFrame, nodes: DataFrame, features: str = "features", start: str = "margin",
                   max_nodes: int = MAX_NODES) -> DataFrame:
    """Adds ``staged``: the margin after each tree on top of the column ``start``.  Map-only."""
    shared = df.sparkSession.sparkContext.broadcast(_arrays(nodes, max_nodes))

    def walk(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for vectors, margins in batches:
            x = np.stack(vectors.to_numpy()) if len(vectors) else np.zeros((0, 1))
            steps = np.cumsum([margins.to_numpy(), *_tree_values(x, shared.value)], axis=0)[1:]
            yield pd.Series(list(steps.T))

    # else Spark copies the call, and the scoring below it, into the filter it infers for an explode
    once = F.pandas_udf(walk, "array<double>").asNondeterministic()
    return df.withColumn("staged", once(F.col(features), F.col(start)))


def verdict_columns(df: DataFrame) -> DataFrame:
    """Label and confidence from the unrounded score, then the 4-digit score."""
    p = clamp01(F.col("score"))
    return df.withColumns({"label": score_to_label(p), "confidence": score_to_confidence(p),
                           "score": F.round(p, 4)})


def contributions_long(df: DataFrame, keys: list[str], contributions: str = "contributions",
                       features: str = "features") -> DataFrame:
    """(keys, feature, value, contribution) rows of a scored frame."""
    rows = [F.struct(F.lit(n).alias("feature"), F.get(features, F.lit(i)).alias("value"),
                     F.get(contributions, F.lit(i)).alias("contribution")) for i, n in enumerate(FEATURE_NAMES)]
    return df.select(*keys, F.inline(F.array(*rows)))
