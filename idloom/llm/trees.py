"""Gradient-boosted trees for a binary label in numpy: fitted on a bounded sample, applied in Arrow batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """``score`` of row x = base + sum over trees of the leaf it reaches. Nodes are numbered as in a heap."""

    base: float
    depth: int
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes: x <= cut goes left
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, penalty: float = 1.0, least: float = 4.0) -> Trees:
    """Logistic boosting over quantile histograms. Deterministic; a constant label gives trees that say only that."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if n else np.zeros((0, d), int)
    p = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    score = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    feature, cut, leaf = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        q = 1 / (1 + np.exp(-score))
        g, h = y - q, q * (1 - q)
        node = np.zeros(n, int)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            at = node - first
            tot_g, tot_h = np.bincount(at, g, width), np.bincount(at, h, width)
            for j in range(d):
                if not len(edges[j]):
                    continue
                key = at * bins + binned[:, j]
                gs = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(1)[:, : len(edges[j])]
                hs = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(1)[:, : len(edges[j])]
                gr, hr = tot_g[:, None] - gs, tot_h[:, None] - hs
                gain = gs**2 / (hs + penalty) + gr**2 / (hr + penalty) - (tot_g**2 / (tot_h + penalty))[:, None]
                gain[(hs < least / 16) | (hr < least / 16)] = -1
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                for i in np.nonzero(top > best)[0]:
                    best[i], feature[t, first + i], cut[t, first + i] = top[i], j, edges[j][k[i]]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > cut[t, node])
        at = node - inner
        leaf[t] = rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + penalty)
        score += leaf[t][at]
    return Trees(base, depth, feature, cut, leaf)
