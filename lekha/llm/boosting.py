"""Gradient-boosted trees for small two-class problems, fitted with numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting of trees of fixed depth over binned features."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 24, least: float = 2.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.start = 0.0
        self.edges: list[np.ndarray] = []
        self.trees: list[list[tuple[np.ndarray, np.ndarray]] | np.ndarray] = []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x, y = np.asarray(x, float), np.asarray(y, float)
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._binned(x)
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.start)
        self.trees = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), np.int64)
            levels: list[tuple[np.ndarray, np.ndarray]] = []
            for level in range(self.depth):
                n = 1 << level
                feature, cut, best = np.zeros(n, np.int64), np.full(n, self.bins), np.zeros(n)
                g, h = np.bincount(node, grad, n), np.bincount(node, hess, n)
                for j in range(x.shape[1]):
                    at = node * (self.bins + 1) + b[:, j]
                    gl = np.cumsum(np.bincount(at, grad, n * (self.bins + 1)).reshape(n, -1), 1)[:, :-1]
                    hl = np.cumsum(np.bincount(at, hess, n * (self.bins + 1)).reshape(n, -1), 1)[:, :-1]
                    gr, hr = g[:, None] - gl, h[:, None] - hl
                    gain = np.where((hl > 1e-3) & (hr > 1e-3), gl**2 / (hl + self.least) + gr**2 / (hr + self.least) - (g**2 / (h + self.least))[:, None], 0)
                    k = gain.argmax(1)
                    better = gain[np.arange(n), k] > best + 1e-9
                    best = np.where(better, gain[np.arange(n), k], best)
                    feature, cut = np.where(better, j, feature), np.where(better, k, cut)
                levels.append((feature, cut))
                node = node * 2 + (b[np.arange(len(y)), feature[node]] > cut[node])
            n = 1 << self.depth
            leaf = self.rate * np.bincount(node, grad, n) / (np.bincount(node, hess, n) + self.least)
            score += leaf[node]
            self.trees.append([*levels, (leaf, leaf)])
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float).reshape(-1, len(self.edges))
        b, rows = self._binned(x), np.arange(len(x))
        score = np.full(len(x), self.start)
        for *levels, (leaf, _) in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in levels:
                node = node * 2 + (b[rows, feature[node]] > cut[node])
            score += leaf[node]
        return 1 / (1 + np.exp(-score))
