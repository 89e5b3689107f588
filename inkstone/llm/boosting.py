"""Gradient-boosted trees for a yes or no, small enough to train on a driver and to send to every worker."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


class Trees:
    """Complete trees of one depth. A node k has children 2k+1 and 2k+2 and goes right where the value exceeds its cut."""

    def __init__(self, base: float, depth: int, columns: np.ndarray, cuts: np.ndarray, values: np.ndarray):
        self.base, self.depth, self.columns, self.cuts, self.values = base, depth, columns, cuts, values

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for columns, cuts, values in zip(self.columns, self.cuts, self.values):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, columns[node]] > cuts[node])
            out += values[node - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, steady: float = 1.0, bins: int = 24) -> Trees:
    """Second-order boosting of the logistic loss with cuts at quantiles."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, c], np.linspace(0, 1, bins + 1)[1:-1])) for c in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, c], side="left") for c, e in enumerate(edges)], axis=1)
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    z = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    all_columns, all_cuts, all_values = [], [], []
    for _ in range(rounds):
        p = sigmoid(z)
        g, h = p - y, p * (1 - p)
        columns, cuts = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for k in range(inner):
            here = np.flatnonzero(node == k)
            best = 1e-9
            if len(here) > 1:
                g_all, h_all = g[here].sum(), h[here].sum()
                for c in range(d):
                    if not len(edges[c]):
                        continue
                    g_bin = np.bincount(binned[here, c], weights=g[here], minlength=len(edges[c]) + 1).cumsum()[:-1]
                    h_bin = np.bincount(binned[here, c], weights=h[here], minlength=len(edges[c]) + 1).cumsum()[:-1]
                    gain = g_bin**2 / (h_bin + steady) + (g_all - g_bin) ** 2 / (h_all - h_bin + steady) - g_all**2 / (h_all + steady)
                    at = int(gain.argmax())
                    if gain[at] > best:
                        best, columns[k], cuts[k] = gain[at], c, edges[c][at]
            node[here] = 2 * k + 1 + (x[here, columns[k]] > cuts[k])
        leaf = node - inner
        values = -rate * np.bincount(leaf, weights=g, minlength=leaves) / (np.bincount(leaf, weights=h, minlength=leaves) + steady)
        z += values[leaf]
        all_columns.append(columns)
        all_cuts.append(cuts)
        all_values.append(values)
    return Trees(base, depth, np.array(all_columns), np.array(all_cuts), np.array(all_values))


def calibrate(raw: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and intercept that turn raw scores into probabilities (Platt)."""
    a, b = 1.0, 0.0
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(rounds):
        p = sigmoid(a * raw + b)
        g, w = p - target, np.maximum(p * (1 - p), 1e-9)
        hessian = np.array([[(w * raw * raw).sum() + 1e-6, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hessian, np.array([(g * raw).sum(), g.sum()]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)
