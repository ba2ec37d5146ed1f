"""Histogram gradient-boosted trees for a binary label, flattened for numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Perfect trees of one depth: node i of a tree splits to 2i + 1 (x <= cut) and 2i + 2."""

    base: float
    depth: int
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = (1 << self.depth) - 1
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.cut[t, node])
            out += self.leaf[t, node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 2.0) -> Forest:
    """Newton boosting on quantile-binned features; `least` is the smallest hessian of a child."""
    n, m = x.shape
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    forest = Forest(float(np.log(mean / (1 - mean))), depth, np.zeros((trees, (1 << depth) - 1), np.int64), np.full((trees, (1 << depth) - 1), np.inf), np.zeros((trees, 1 << depth)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(m)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(m)], 1)
    flat = binned + np.arange(m) * bins
    margin = np.full(n, forest.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * (m * bins) + flat).ravel()
            gs, hs = (np.bincount(at, np.repeat(v, m), width * m * bins).reshape(width, m, bins).cumsum(2) for v in (g, h))
            ga, ha = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + l2) + (ga - gs) ** 2 / (ha - hs + l2) - ga**2 / (ha + l2)
            gain[(hs < least) | (ha - hs < least)] = 0
            best = gain.reshape(width, -1).argmax(1)
            feature, split = best // bins, best % bins
            for k in range(width):
                if gain[k, feature[k], split[k]] > 1e-6 and split[k] < len(edges[feature[k]]):
                    forest.feature[t, first + k], forest.cut[t, first + k] = feature[k], edges[feature[k]][split[k]]
            node = 2 * node + 1 + (x[np.arange(n), forest.feature[t, node]] > forest.cut[t, node])
        leaf = node - ((1 << depth) - 1)
        forest.leaf[t] = -rate * np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + l2)
        margin += forest.leaf[t, leaf]
    return forest
