"""Gradient-boosted trees for several classes, in numpy: binned features, symmetric histograms, softmax loss."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Complete trees of a fixed depth; a node without a useful split sends everything left."""

    def __init__(self, classes: int, rounds: int = 30, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0):
        self.classes, self.rounds, self.depth, self.rate, self.bins, self.ridge = classes, rounds, depth, rate, bins, ridge
        self.edges: list[np.ndarray] = []
        self.feature = np.zeros((0, 0), np.int64)
        self.split = np.zeros((0, 0), np.int64)
        self.leaf = np.zeros((0, 0))

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)])

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(np.unique(x[:, j]), np.linspace(0, 1, self.bins)[:-1])) for j in range(x.shape[1])]
        b = self._binned(x)
        n, f = b.shape
        wide = self.bins + 1
        flat = b + np.arange(f) * wide
        score = np.zeros((n, self.classes))
        features, splits, leaves = [], [], []
        for _ in range(self.rounds):
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for c in range(self.classes):
                g, h = p[:, c] - (y == c), np.maximum(p[:, c] * (1 - p[:, c]), 1e-6)
                node = np.zeros(n, np.int64)
                feature, split = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, wide)
                for level in range(self.depth):
                    width = 2**level
                    index = (node[:, None] * (f * wide) + flat).ravel()
                    sums = [np.bincount(index, np.repeat(v, f), width * f * wide).reshape(width, f, wide).cumsum(2) for v in (g, h)]
                    total = [s[:, :, -1:] for s in sums]
                    gain = sum((sums[0] - k * total[0]) ** 2 / (k * total[1] + (1 - 2 * k) * sums[1] + self.ridge) for k in (0, 1)) - total[0] ** 2 / (total[1] + self.ridge)
                    gain[:, :, -1] = 0
                    best = gain.reshape(width, -1).argmax(1)
                    good = gain.reshape(width, -1)[np.arange(width), best] > 1e-3
                    feature[width - 1 : 2 * width - 1] = best // wide
                    split[width - 1 : 2 * width - 1] = np.where(good, best % wide, wide)
                    here = node + width - 1
                    node = 2 * node + (b[np.arange(n), feature[here]] > split[here])
                sums = [np.bincount(node, v, 2**self.depth) for v in (g, h)]
                leaf = -self.rate * sums[0] / (sums[1] + self.ridge)
                score[:, c] += leaf[node]
                features.append(feature)
                splits.append(split)
                leaves.append(leaf)
        self.feature, self.split, self.leaf = np.array(features), np.array(splits), np.array(leaves)
        return self

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        n = len(b)
        score = np.zeros((n, self.classes))
        rows = np.arange(n)
        for t in range(len(self.leaf)):
            node = np.zeros(n, np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, self.feature[t][node]] > self.split[t][node])
            score[:, t % self.classes] += self.leaf[t][node - (2**self.depth - 1)]
        score -= score.max(1, keepdims=True)
        return score - np.log(np.exp(score).sum(1, keepdims=True))
