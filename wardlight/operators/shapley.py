"""Exact contributions of features to the margin of a tree ensemble.

A tree asked about some features only follows a split on a known feature and takes the
mean of both sides, by the share of training rows, at any other.  A feature's
contribution is its Shapley value in that game.  A leaf's part in it depends on the row
only through which of the path's features lead there, so it is worked out once for each
such pattern and looked up for the rows.
"""

from __future__ import annotations

import numpy as np


class LeafPath:
    """A leaf and the conditions to reach it, one interval for each feature of its path."""

    def __init__(self, value: float, conditions: dict[int, tuple[float, float, float]]):
        self.value = value
        self.features = sorted(conditions)
        self.low, self.high, self.share = (
            np.array([conditions[f][i] for f in self.features]) for i in range(3))

    def patterns(self, x: np.ndarray) -> np.ndarray:
        """For each row a number whose bit i tells whether feature i leads to the leaf.

        A missing value goes right at every split, as in scoring.
        """
        code = np.zeros(len(x), np.int64)
        for i, f in enumerate(self.features):
            right = ~(x[:, f] <= self.low[i])
            meets = right if self.high[i] == np.inf else right & (x[:, f] <= self.high[i])
            code |= meets.astype(np.int64) << i
        return code

    def pushes(self, codes: np.ndarray) -> np.ndarray:
        """Contribution of each feature of the path (a column) under each pattern.

        With o 1 where a feature leads to the leaf and z the share of rows that its splits
        let through, the weights of all subsets of the other features add up to the
        integral over t in 0..1 of the product of z (1 - t) + o t: a polynomial one
        degree below the path's width, which Gauss-Legendre nodes integrate exactly.
        """
        width = len(self.features)
        nodes, weights = np.polynomial.legendre.leggauss((width + 1) // 2)
        t, weights = (nodes + 1) / 2, weights / 2
        o = ((codes[:, None] >> np.arange(width)) & 1).astype(float)
        factors = self.share[:, None] * (1 - t) + o[:, :, None] * t
        others = np.ones_like(factors)
        others[:, 1:] = np.cumprod(factors, axis=1)[:, :-1]
        others[:, :-1] *= np.cumprod(factors[:, ::-1], axis=1)[:, ::-1][:, 1:]
        return self.value * (o - self.share) * (others @ weights)


def leaf_paths(model: dict[str, np.ndarray]) -> tuple[float, list[LeafPath]]:
    """The ensemble's mean margin and its leaves with a split above them.

    Shares of rows come from ``cover``; below a node that no row reached both sides count half.
    """
    mean, paths = 0.0, []
    for root in model["roots"]:
        waiting = [(root, {})]
        while waiting:
            node, conditions = waiting.pop()
            if model["left"][node] < 0:
                value = float(model["weight"][root] * model["value"][node])
                mean += value * float(np.prod([c[2] for c in conditions.values()]))
                if conditions:
                    paths.append(LeafPath(value, conditions))
                continue
            feature, cut = int(model["feature"][node]), float(model["threshold"][node])
            low, high, share = conditions.get(feature, (-np.inf, np.inf, 1.0))
            left, right = model["left"][node], model["right"][node]
            both = model["cover"][left] + model["cover"][right]
            part = model["cover"][left] / both if both > 0 else 0.5
            waiting.append((left, {**conditions, feature: (low, min(high, cut), share * part)}))
            waiting.append((right, {**conditions, feature: (max(low, cut), high, share * (1 - part))}))
    return mean, paths


def contributions(x: np.ndarray, paths: list[LeafPath], width: int) -> np.ndarray:
    """Rows by features; with the mean margin a row adds up to its margin."""
    out = np.zeros((width, len(x)))
    for path in paths:
        codes = path.patterns(x)
        every = 1 << len(path.features)
        seen, place = (np.arange(every), codes) if every <= len(codes) else np.unique(codes, return_inverse=True)
        pushes = path.pushes(seen)
        for i, f in enumerate(path.features):
            out[f] += pushes[place, i]
    return out.T
