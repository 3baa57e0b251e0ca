"""A small random forest for bounded labelled samples; scoring runs inside tasks."""

from __future__ import annotations

import numpy as np


class Forest:
    """Bagged Gini trees, each split over a random choice of features."""

    def __init__(self, trees: int = 40, depth: int = 7, least: int = 3, seed: int = 7):
        self.trees, self.depth, self.least, self.seed = trees, depth, least, seed
        self.roots: list[tuple] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        draw = np.random.default_rng(self.seed)
        for _ in range(self.trees):
            rows = draw.integers(0, len(y), len(y))
            self.roots.append(self._grow(x[rows], y[rows].astype(float), self.depth, draw))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, draw: np.random.Generator) -> tuple:
        share = float(y.mean())
        if depth == 0 or len(y) < 2 * self.least or share in (0.0, 1.0):
            return (share,)
        best = None
        for f in draw.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1]))), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, hits = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y))
            left, right = hits[:-1] / n, (hits[-1] - hits[:-1]) / (len(y) - n)
            impurity = n * left * (1 - left) + (len(y) - n) * right * (1 - right)
            impurity[(v[1:] == v[:-1]) | (n < self.least) | (len(y) - n < self.least)] = np.inf
            k = int(np.argmin(impurity))
            if np.isfinite(impurity[k]) and (best is None or impurity[k] < best[0]):
                best = (impurity[k], int(f), float((v[k] + v[k + 1]) / 2))
        if best is None:
            return (share,)
        low = x[:, best[1]] <= best[2]
        return (best[1], best[2], self._grow(x[low], y[low], depth - 1, draw), self._grow(x[~low], y[~low], depth - 1, draw))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean share of label 1 in the leaves that each row reaches."""
        total = np.zeros(len(x))
        for root in self.roots:
            self._walk(root, x, np.arange(len(x)), total)
        return total / max(1, len(self.roots))

    def _walk(self, node: tuple, x: np.ndarray, rows: np.ndarray, total: np.ndarray) -> None:
        if not len(rows):
            return
        if len(node) == 1:
            total[rows] += node[0]
            return
        low = x[rows, node[0]] <= node[1]
        self._walk(node[2], x, rows[low], total)
        self._walk(node[3], x, rows[~low], total)
