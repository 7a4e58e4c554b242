"""Gradient-boosted regression trees over a weighted table of integer features.

The table holds one row per distinct feature vector and label with its
count, so its size is bounded by the feature grid and not by the corpus.
Trained trees become SQL expressions and run inside Spark's own code.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS, DEPTH, RATE, L2 = 24, 3, 0.3, 1.0


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int):
    """A leaf value, or (feature, bound, tree of x <= bound, tree of x > bound)."""
    g, h = grad.sum(), hess.sum()
    best, found = 1e-6, None
    if depth:
        for f in range(x.shape[1]):
            for bound in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= bound
                gl, hl = grad[left].sum(), hess[left].sum()
                gain = gl**2 / (hl + L2) + (g - gl) ** 2 / (h - hl + L2) - g**2 / (h + L2)
                if gain > best:
                    best, found = gain, (f, int(bound), left)
    if found is None:
        return float(-RATE * g / (h + L2))
    f, bound, left = found
    return (f, bound, _grow(x[left], grad[left], hess[left], depth - 1),
            _grow(x[~left], grad[~left], hess[~left], depth - 1))


def _value(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, bound, low, high = tree
    return np.where(x[:, f] <= bound, _value(low, x), _value(high, x))


def margins(model: dict, x: np.ndarray) -> np.ndarray:
    """Log-odds of each row."""
    out = np.full(len(x), model["base"])
    for tree in model["trees"]:
        out = out + _value(tree, x)
    return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    """Logistic gradient boosting with Newton leaves."""
    rate = float(np.clip((y * weight).sum() / weight.sum(), 1e-6, 1 - 1e-6))
    model = {"base": float(np.log(rate / (1 - rate))), "trees": []}
    score = np.full(len(x), model["base"])
    for _ in range(ROUNDS):
        p = 1.0 / (1.0 + np.exp(-score))
        tree = _grow(x, weight * (p - y), weight * p * (1 - p), DEPTH)
        if not isinstance(tree, tuple):
            break
        model["trees"].append(tree)
        score = score + _value(tree, x)
    return model


def threshold(score: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float) -> float:
    """The lowest score whose calibrated share of label 1 reaches ``rate``; infinite if none does.

    Shares are calibrated by isotonic regression: of equal scores the weighted
    mean, and neighbours that would fall with the score are pooled.
    """
    blocks: list[list[float]] = []  # lowest score, weight of label 1, weight
    for s in np.unique(score):
        at = score == s
        blocks.append([float(s), float((y * weight)[at].sum()), float(weight[at].sum())])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            low = blocks.pop(-2)
            blocks[-1] = [low[0], low[1] + blocks[-1][1], low[2] + blocks[-1][2]]
    return next((s for s, hits, all_ in blocks if hits >= rate * all_), float("inf"))


def as_column(model: dict, columns: list[Column]) -> Column:
    """The log-odds as a SQL expression over the feature columns."""
    def node(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(tree)
        f, bound, low, high = tree
        return F.when(columns[f] <= bound, node(low)).otherwise(node(high))

    total = F.lit(model["base"])
    for tree in model["trees"]:
        total = total + node(tree)
    return total
