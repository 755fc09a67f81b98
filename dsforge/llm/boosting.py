"""Gradient-boosted trees for two classes over binned features, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of fixed depth under the logistic loss; each tree looks at a share ``columns`` of the features, drawn at random, so no single one decides alone. ``fit`` works on a bounded sample in memory, ``predict`` on any batch."""

    def __init__(self, trees: int = 50, depth: int = 4, rate: float = 0.25, bins: int = 32, l2: float = 1.0, columns: float = 1.0):
        self.n, self.depth, self.rate, self.bins, self.l2, self.columns = trees, depth, rate, bins, l2, columns
        self.feature, self.cut, self.value, self.start = [], [], [], 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        rows, width = x.shape
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
        mean = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.start = float(np.log(mean / (1 - mean)))
        z = np.full(rows, self.start)
        offset = np.arange(width) * self.bins
        drawn = np.random.RandomState(5)
        for _ in range(self.n):
            hidden = np.ones(width, bool)
            hidden[drawn.permutation(width)[: max(1, round(self.columns * width))]] = False
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            node = np.zeros(rows, np.int64)
            feature, cut, cut_bin = [], [], []
            for level in range(self.depth):
                count = 1 << level
                flat = ((node[:, None] * width * self.bins) + offset + binned).ravel()
                shape = (count, width, self.bins)
                gs = np.cumsum(np.bincount(flat, np.repeat(g, width), count * width * self.bins).reshape(shape), 2)
                hs = np.cumsum(np.bincount(flat, np.repeat(h, width), count * width * self.bins).reshape(shape), 2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2)
                gain[(hs < 1) | (ht - hs < 1)] = -1
                gain[:, hidden] = -2
                best = gain.reshape(count, -1).argmax(1)
                f, b = best // self.bins, best % self.bins
                feature.append(f)
                cut.append(np.array([edges[i][j] if j < len(edges[i]) else np.inf for i, j in zip(f, b)]))
                cut_bin.append(b)
                node = node * 2 + (binned[np.arange(rows), f[node]] > b[node])
            leaves = 1 << self.depth
            value = self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.l2)
            z += value[node]
            self.feature.append(feature), self.cut.append(cut), self.value.append(value)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the second class."""
        z = np.full(len(x), self.start)
        at = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for f, c in zip(feature, cut):
                node = node * 2 + (x[at, f[node]] > c[node])
            z += value[node]
        return z
