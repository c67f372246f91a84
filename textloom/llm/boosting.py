"""Gradient boosted trees for small feature vectors, trained and read with numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete trees of equal depth; a row goes right where its feature is above the cut."""

    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray
    leaf: np.ndarray  # (trees, leaves)
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the rows of ``x``."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = self.leaf.shape[1].bit_length() - 1
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            total += leaf[node - len(f)]
        return 1.0 / (1.0 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.3, least: float = 2.0) -> Trees:
    """Second-order boosting of the logistic loss; ties go to the lower feature and cut."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 25))) for j in range(x.shape[1])]
    codes = [np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    f = np.full(len(y), base)
    inner, leaves = 2**depth - 1, 2**depth
    features, points, values = [], [], []
    for _ in range(rounds):
        q = 1.0 / (1.0 + np.exp(-f))
        g, h = y - q, q * (1 - q) + 1e-6
        node = np.zeros(len(y), dtype=np.int64)
        tf, tc = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for i in range(inner):
            rows = np.flatnonzero(node == i)
            best = (1e-6, 0, np.inf)
            if len(rows) > 1:
                gs, hs = g[rows].sum(), h[rows].sum()
                for j, c in enumerate(cuts):
                    k = codes[j][rows]
                    gl = np.cumsum(np.bincount(k, g[rows], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(k, h[rows], len(c) + 1))[:-1]
                    ok = (hl > least / 10) & (hs - hl > least / 10)
                    gain = np.where(ok, gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1), -1.0)
                    if len(gain) and gain.max() > best[0] + 1e-9:
                        b = int(gain.argmax())
                        best = (float(gain[b]), j, float(c[b]))
            tf[i], tc[i] = best[1], best[2]
            node[rows] = 2 * i + 1 + (x[rows, best[1]] > best[2])
        leaf = np.zeros(leaves)
        for k in range(leaves):
            rows = node == inner + k
            if rows.any():
                leaf[k] = rate * g[rows].sum() / (h[rows].sum() + 1)
        f += leaf[node - inner]
        features.append(tf)
        points.append(tc)
        values.append(leaf)
    return Trees(np.array(features), np.array(points), np.array(values), base)


def best_threshold(p: np.ndarray, y: np.ndarray, missed: int = 0) -> float:
    """Probability from which on the F1 measure is greatest; ``missed`` true cases have no row."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum() + missed)
    ends = np.flatnonzero(np.diff(np.append(p[order], -1.0)) != 0)  # equal probabilities stay together
    if not len(ends):
        return 0.5
    best = ends[int(f1[ends].argmax())]
    after = p[order][best + 1] if best + 1 < len(p) else 0.0
    return float((p[order][best] + after) / 2)
