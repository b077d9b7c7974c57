"""Small gradient-boosted trees that become SQL expressions.

Fitted in numpy on a bounded set of labelled rows (the bound is the caller's
parameter), used in Spark as a sum of nested CASE WHEN columns, so that scoring
needs no Python on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """A leaf (feature < 0) or a split: left if the feature is at most the cut."""

    feature: int
    cut: float
    value: float
    left: Node | None = None
    right: Node | None = None


@dataclass(frozen=True)
class Boosted:
    """Trees over named features, with Platt's calibration of their sum."""

    names: tuple[str, ...]
    base: float
    trees: tuple[Node, ...]
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += _apply(tree, x)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.shift)))

    def raw_column(self, features: dict[str, Column]) -> Column:
        """The sum of the trees as one expression on the feature columns."""

        def case(node: Node) -> Column:
            if node.feature < 0:
                return F.lit(node.value)
            return F.when(features[self.names[node.feature]] <= node.cut, case(node.left)).otherwise(case(node.right))

        out = F.lit(self.base)
        for tree in self.trees:
            out = out + case(tree)
        return out

    def cut_at(self, probability: float) -> float:
        """The raw sum at which the calibrated probability is reached."""
        return (float(np.log(probability / (1 - probability))) - self.shift) / self.slope


def _apply(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    left = x[:, node.feature] <= node.cut
    out = np.empty(len(x))
    out[left], out[~left] = _apply(node.left, x[left]), _apply(node.right, x[~left])
    return out


def _grow(x: np.ndarray, slope: np.ndarray, bend: np.ndarray, depth: int, rate: float, ridge: float) -> Node:
    total_g, total_h = slope.sum(), bend.sum()
    leaf = Node(-1, 0.0, float(np.round(rate * total_g / (total_h + ridge), 6)))
    if not depth:
        return leaf
    best = (1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, g, h = x[order, f], np.cumsum(slope[order]), np.cumsum(bend[order])
        at = np.flatnonzero(v[1:] != v[:-1])
        if not len(at):
            continue
        gain = g[at] ** 2 / (h[at] + ridge) + (total_g - g[at]) ** 2 / (total_h - h[at] + ridge) - total_g**2 / (total_h + ridge)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), f, float((v[at[k]] + v[at[k] + 1]) / 2))
    if best[1] < 0:
        return leaf
    left = x[:, best[1]] <= best[2]
    return Node(best[1], best[2], 0.0, *(_grow(x[s], slope[s], bend[s], depth - 1, rate, ridge) for s in (left, ~left)))


def fit(names: tuple[str, ...], x: np.ndarray, y: np.ndarray, held_x: np.ndarray, held_y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> Boosted:
    """Logistic boosting by Newton steps, then Platt's calibration on held-out rows."""
    rate_of = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(rate_of / (1 - rate_of)))
    raw, grown = np.full(len(x), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grown.append(_grow(x, y - p, p * (1 - p), depth, rate, ridge))
        raw += _apply(grown[-1], x)
    model = Boosted(names, base, tuple(grown))
    s, a, b = model.raw(held_x), 1.0, 0.0
    target = np.where(held_y > 0, (held_y.sum() + 1) / (held_y.sum() + 2), 1 / ((1 - held_y).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * s + b)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - target) * s).sum(), (p - target).sum()])
        h = np.array([[(w * s * s).sum() + 1e-6, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-10:
            break
    return Boosted(names, base, tuple(grown), float(a), float(b))
