"""Gradient-boosted trees: fitted with numpy on a bounded sample, scored as Spark expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Model:
    """trees: nested (feature, threshold, left, right), leaves are floats; p = sigmoid(scale * margin + shift)."""

    features: tuple[str, ...]
    base: float
    trees: tuple
    scale: float = 1.0
    shift: float = 0.0

    def margin(self) -> Column:
        def walk(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, bound, left, right = node
            return F.when(F.col(self.features[feature]) <= bound, walk(left)).otherwise(walk(right))

        total = F.lit(self.base)
        for tree in self.trees:
            total = total + walk(tree)
        return total

    def probability(self) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(self.margin() * self.scale + self.shift)))

    def margins(self, x: np.ndarray) -> np.ndarray:
        def walk(node, row):
            while not isinstance(node, float):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            return node

        return np.array([self.base + sum(walk(t, row) for t in self.trees) for row in x])


def fit(features: list[str], x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 3, bins: int = 64, rate: float = 0.3, ridge: float = 1.0, least: int = 4) -> Model:
    """Logistic boosting with histogram splits. x: rows by features, y: 0 or 1."""
    base = math.log((y.sum() + 1.0) / (len(y) - y.sum() + 1.0))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    codes = np.stack([np.searchsorted(k, c) for k, c in zip(cuts, x.T)], axis=1)
    margin, trees = np.full(len(y), base), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            for f in range(x.shape[1]):
                if not len(cuts[f]):
                    continue
                size = len(cuts[f]) + 1
                gs, hs, ns = (np.cumsum(np.bincount(codes[rows, f], weights=v, minlength=size))[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
                gain = gs**2 / (hs + ridge) + (total_g - gs) ** 2 / (total_h - hs + ridge) - total_g**2 / (total_h + ridge)
                gain[(ns < least) | (len(rows) - ns < least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (f, k))
        if best[1] is None:
            return float(-rate * total_g / (total_h + ridge))
        f, k = best[1]
        left = codes[rows, f] <= k
        return (f, float(cuts[f][k]), grow(rows[left], g, h, level + 1), grow(rows[~left], g, h, level + 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(np.arange(len(y)), p - y, p * (1 - p), 0)
        if isinstance(tree, float):
            break
        trees.append(tree)
        margin = margin + Model(tuple(features), 0.0, (tree,)).margins(x)
    return Model(tuple(features), base, tuple(trees))


def calibrated(model: Model, x: np.ndarray, y: np.ndarray, steps: int = 100, ridge: float = 0.5) -> Model:
    """Platt scaling on a holdout: softened targets, and a pull towards the uncalibrated scale, as holdouts are small."""
    if len(set(y.tolist())) < 2:
        return model
    m, (pos, neg) = model.margins(x), (y.sum(), len(y) - y.sum())
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))

    def loss(v: np.ndarray) -> float:
        z = v[0] * m + v[1]
        return float((np.logaddexp(0, z) - t * z).sum() + ridge * ((v[0] - 1) ** 2 + v[1] ** 2))

    v = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 0.5 * (1 + np.tanh((v[0] * m + v[1]) / 2))
        w = p * (1 - p)
        grad = np.array([((p - t) * m).sum() + 2 * ridge * (v[0] - 1), (p - t).sum() + 2 * ridge * v[1]])
        hess = np.array([[(w * m * m).sum() + 2 * ridge, (w * m).sum()], [(w * m).sum(), w.sum() + 2 * ridge]])
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-6 and loss(v - size * step) > loss(v):
            size /= 2
        v = v - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return Model(model.features, model.base, model.trees, float(v[0]), float(v[1]))
