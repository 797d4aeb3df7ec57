"""Gradient-boosted trees for yes-or-no labels over a bounded table of numbers, with calibrated probabilities."""

from __future__ import annotations

import numpy as np


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Boosted:
    """Small trees on the log-odds, each fitted to the gradient that is left; splits at quantiles of a feature."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 4.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        code = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], 1)
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score = np.full(len(y), self.start)
        self.forest = []
        for _ in range(self.trees):
            p = _sigmoid(score)
            tree = self._grow(code, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            self.forest.append(tree)
            score += self.rate * self._walk(tree, x)
        self.scale = (1.0, 0.0)
        return self

    def _grow(self, code, grad, hess, rows, depth):
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, None, None)
        if depth and len(rows) >= 2 * self.least:
            for f in range(code.shape[1]):
                n = len(self.edges[f]) + 1
                own = code[rows, f]
                gs, hs, ns = (np.cumsum(np.bincount(own, w, n))[:-1] for w in (grad[rows], hess[rows], np.ones(len(rows))))
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(ns < self.least) | (len(rows) - ns < self.least)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()))
        if best[1] is None:
            return g / (h + 1)
        _, f, k = best
        low = code[rows, f] <= k
        return f, float(self.edges[f][k]), self._grow(code, grad, hess, rows[low], depth - 1), self._grow(code, grad, hess, rows[~low], depth - 1)

    def _walk(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, edge, low, high = tree
        left = x[:, f] <= edge
        out = np.empty(len(x))
        out[left] = self._walk(low, x[left])
        out[~left] = self._walk(high, x[~left])
        return out

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.forest:
            out += self.rate * self._walk(tree, x)
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray, rounds: int = 100) -> Boosted:
        """Fits a logistic curve to the log-odds of rows that the trees haven't seen."""
        z = self.log_odds(x)
        a, b = 1.0, 0.0
        for _ in range(rounds):
            p = _sigmoid(a * z + b)
            w = p * (1 - p) + 1e-9
            d = np.array([((y - p) * z).sum() - 1e-3 * (a - 1), (y - p).sum() - 1e-3 * b])
            m = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            step = np.clip(np.linalg.solve(m, d), -1, 1)
            a, b = a + step[0], b + step[1]
        self.scale = (max(a, 1e-3), b)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale[0] * self.log_odds(x) + self.scale[1])


def threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest probability from which on at least that share is positive; above 1 if none is."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.flatnonzero((right >= precision) & np.append(p[order][1:] < p[order][:-1], True))
    return float(p[order][last[-1]]) if len(last) else 1.1
