"""Gradient-boosted trees with a logistic loss, and isotonic calibration, for small dense tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DEPTH = 3


@dataclass
class Boosted:
    base: float
    rate: float
    features: np.ndarray  # trees x inner nodes, by level
    cuts: np.ndarray
    leaves: np.ndarray  # trees x 2**DEPTH

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.features, self.cuts, self.leaves, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += self.rate * v[at - len(f)]
        return out


def fit_boosted(x: np.ndarray, y: np.ndarray, trees: int = 60, rate: float = 0.2, bins: int = 64, least: float = 1.0, ridge: float = 1.0) -> Boosted:
    """Histogram boosting; ``least`` is the smallest sum of second derivatives in a leaf."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    rate0 = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    model = Boosted(float(np.log(rate0 / (1 - rate0))), rate, np.zeros((trees, 2**DEPTH - 1), np.int64), np.full((trees, 2**DEPTH - 1), np.inf), np.zeros((trees, 2**DEPTH)))
    margin = np.full(n, model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            for j in range(d):
                if len(edges[j]) == 0:
                    continue
                cell = (node - first) * bins + codes[:, j]
                g = np.bincount(cell, grad, width * bins).reshape(width, bins)
                h = np.bincount(cell, hess, width * bins).reshape(width, bins)
                gl, hl = g.cumsum(1)[:, : len(edges[j])], h.cumsum(1)[:, : len(edges[j])]
                ga, ha = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                gain[(hl < least) | (ha - hl < least)] = -1
                top = gain.argmax(1)
                won = gain[np.arange(width), top] > best
                best[won] = gain[np.arange(width), top][won]
                model.features[t, first : first + width][won] = j
                model.cuts[t, first : first + width][won] = edges[j][top[won]]
            node = 2 * node + 1 + (x[np.arange(n), model.features[t, node]] > model.cuts[t, node])
        leaf = node - (2**DEPTH - 1)
        g, h = np.bincount(leaf, grad, 2**DEPTH), np.bincount(leaf, hess, 2**DEPTH)
        model.leaves[t] = g / (h + ridge)
        margin += rate * model.leaves[t][leaf]
    return model


def fit_isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (margin, probability), nondecreasing in both."""
    order = np.argsort(margin, kind="stable")
    pools: list[list[float]] = []  # sum of y, rows, sum of margins
    for m, v in zip(margin[order], y[order], strict=True):
        pools.append([float(v), 1.0, float(m)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            v1, n1, m1 = pools.pop()
            pools[-1] = [pools[-1][0] + v1, pools[-1][1] + n1, pools[-1][2] + m1]
    return np.array([m / n for _, n, m in pools]), np.array([v / n for v, n, _ in pools])
