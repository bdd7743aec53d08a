"""Gradient-boosted trees for binary labels: logistic loss, quantile-binned features, Newton leaves."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Complete trees of a fixed depth stored as arrays; scoring is a few vector operations a tree."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T, strict=True)], 1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            feature, threshold = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, np.inf)
            node = np.zeros(len(y), int)
            for level in range(self.depth):
                for k in range(2**level):
                    at, i = 2**level - 1 + k, np.flatnonzero(node == k)
                    best = 1e-6
                    if len(i) < 8:
                        continue
                    total_g, total_h = g[i].sum(), h[i].sum()
                    for j, q in enumerate(cuts):
                        if not len(q):
                            continue
                        gs = np.bincount(binned[i, j], g[i], len(q) + 1).cumsum()[:-1]
                        hs = np.bincount(binned[i, j], h[i], len(q) + 1).cumsum()[:-1]
                        gain = gs**2 / (hs + self.l2) + (total_g - gs) ** 2 / (total_h - hs + self.l2) - total_g**2 / (total_h + self.l2)
                        b = int(gain.argmax())
                        if gain[b] > best:
                            best, feature[at], threshold[at] = gain[b], j, q[b]
                node = 2 * node + (x[np.arange(len(y)), feature[2**level - 1 + node]] > threshold[2**level - 1 + node])
            leaf = self.rate * np.bincount(node, g, 2**self.depth) / (np.bincount(node, h, 2**self.depth) + self.l2)
            self.trees.append((feature, threshold, leaf))
            f += leaf[node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in self.trees:
            node = np.zeros(len(x), int)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (x[rows, feature[at]] > threshold[at])
            f += leaf[node]
        return 1 / (1 + np.exp(-f))
