"""Gradient-boosted trees for a yes-or-no label, in numpy.

Trees are complete to a fixed depth; splits are found on quantile bins by the usual
second-order gain. Small enough to fit on the driver from a bounded training set.
"""

from __future__ import annotations

import numpy as np


class Boosted:
    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, calm: float = 2.0):
        self.trees, self.depth, self.rate, self.bins, self.calm = trees, depth, rate, bins, calm
        self.features: list[np.ndarray] = []
        self.cuts: list[np.ndarray] = []
        self.values: list[np.ndarray] = []
        self.bias = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        n, width = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(width)]
        coded = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        total = np.full(n, self.bias)
        inner = (1 << self.depth) - 1
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-total))
            g, h = y - p, p * (1 - p)
            feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, count = (1 << level) - 1, 1 << level
                local = node - first
                best = np.full(count, 1e-6)
                for j in range(width):
                    size = len(edges[j]) + 1
                    if size < 2:
                        continue
                    key = local * size + coded[:, j]
                    gs = np.bincount(key, g, count * size).reshape(count, size).cumsum(axis=1)
                    hs = np.bincount(key, h, count * size).reshape(count, size).cumsum(axis=1)
                    ga, ha = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.calm) + (ga - gs) ** 2 / (ha - hs + self.calm) - ga**2 / (ha + self.calm)
                    at = gain[:, :-1].argmax(axis=1)
                    top = gain[np.arange(count), at]
                    better = top > best
                    best[better] = top[better]
                    feature[first : first + count][better] = j
                    cut[first : first + count][better] = edges[j][at[better]]
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
            leaf = node - inner
            value = self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.calm)
            total += value[leaf]
            self.features.append(feature)
            self.cuts.append(cut)
            self.values.append(value)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of label 1."""
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        inner = (1 << self.depth) - 1
        for feature, cut, value in zip(self.features, self.cuts, self.values, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += value[node - inner]
        return total
