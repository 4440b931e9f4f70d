"""Gradient-boosted trees on dense features (logistic loss, histogram splits) and isotonic calibration, in NumPy.

Fits happen on the driver over bounded samples; the fitted model is a small picklable object that tasks score with.
"""

from __future__ import annotations

import numpy as np


class Boosted:
    """Binary classifier. Deterministic: no row or column sampling; ties between splits go to the lower feature and bin."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 1.0, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge
        self.base, self.nodes = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x, y = np.asarray(x, float), np.asarray(y, float)
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1], method="nearest")) if len(c) else np.empty(0) for c in x.T]
        coded = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1) if x.shape[1] else np.zeros((len(x), 0), int)
        p = min(max(y.mean(), 1e-4), 1 - 1e-4) if len(y) else 0.5
        self.base, f = float(np.log(p / (1 - p))), np.full(len(y), np.log(p / (1 - p)))
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-f))
            g, h = y - q, q * (1 - q)
            feature, cut, value = np.full(2**self.depth - 1, -1), np.zeros(2**self.depth - 1), np.zeros(2 ** (self.depth + 1) - 1)
            at = np.zeros(len(y), int)
            for node in range(len(value)):
                rows = np.flatnonzero(at == node)
                gs, hs = g[rows].sum(), h[rows].sum()
                value[node] = self.rate * gs / (hs + self.ridge)
                if node >= len(feature) or len(rows) < 2:
                    continue
                best = 1e-6
                for k, e in enumerate(edges):
                    if not len(e):
                        continue
                    gl = np.cumsum(np.bincount(coded[rows, k], g[rows], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(coded[rows, k], h[rows], len(e) + 1))[:-1]
                    gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                    gain[(hl < self.least) | (hs - hl < self.least)] = 0
                    j = int(np.argmax(gain))
                    if gain[j] > best:
                        best, feature[node], cut[node] = gain[j], k, e[j]
                if feature[node] >= 0:
                    at[rows] = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            f = f + value[self._leaf(x, feature, cut)]
            self.nodes.append((feature, cut, value))
        return self

    def _leaf(self, x: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        for _ in range(self.depth):
            k = feature[np.minimum(at, len(feature) - 1)]
            go = (at < len(feature)) & (k >= 0)
            step = x[np.arange(len(x)), np.maximum(k, 0)] > cut[np.minimum(at, len(feature) - 1)]
            at = np.where(go, 2 * at + 1 + step, at)
        return at

    def margin(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        f = np.full(len(x), self.base)
        for feature, cut, value in self.nodes:
            f += value[self._leaf(x, feature, cut)]
        return f

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


class Isotonic:
    """Pool-adjacent-violators fit of label on score; equal scores are one pool first. Linear between the pools' centres, constant beyond them."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        values, which, counts = np.unique(np.asarray(score, float), return_inverse=True, return_counts=True)
        sums = np.bincount(which.ravel(), np.asarray(y, float), len(values))
        pools: list[list[float]] = []  # sum of labels, sum of scores, count
        for s, t, n in zip(values.tolist(), sums.tolist(), counts.tolist(), strict=True):
            pools.append([t, s * n, float(n)])
            while len(pools) > 1 and pools[-2][0] * pools[-1][2] >= pools[-1][0] * pools[-2][2]:
                a = pools.pop()
                pools[-1] = [u + v for u, v in zip(pools[-1], a, strict=True)]
        self.x, self.y = np.array([p[1] / p[2] for p in pools] or [0.0]), np.array([p[0] / p[2] for p in pools] or [0.5])
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(score, self.x, self.y), 0.0, 1.0)
