"""Gradient-boosted trees of fixed depth in flat numpy arrays, with monotonic constraints."""

from __future__ import annotations

import numpy as np

DEPTH, TREES, RATE, BINS, L2, LEAST = 3, 60, 0.2, 64, 2.0, 8


class Trees:
    """``feature`` and ``cut`` have the 2 ** DEPTH - 1 inner nodes of each tree, level by level; ``leaf`` its leaves."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.cut, self.leaf = base, feature, cut, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the rows of ``x``."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def _best_split(binned, grad, hess, rows, signs, low, high):
    """(gain, feature, bin) of the best allowed split of ``rows``; leaf values are held within low and high."""
    value = lambda g, h: np.clip(-g / (h + L2), low, high)
    loss = lambda g, h, v: g * v + 0.5 * (h + L2) * v * v
    best = (1e-6, -1, -1)
    g_all, h_all = grad[rows].sum(), hess[rows].sum()
    now = loss(g_all, h_all, value(g_all, h_all))
    for f in range(binned.shape[1]):
        b = binned[rows, f]
        g = np.cumsum(np.bincount(b, grad[rows], BINS))[:-1]
        h = np.cumsum(np.bincount(b, hess[rows], BINS))[:-1]
        n = np.cumsum(np.bincount(b, minlength=BINS))[:-1]
        left, right = value(g, h), value(g_all - g, h_all - h)
        gain = now - loss(g, h, left) - loss(g_all - g, h_all - h, right)
        ok = (n >= LEAST) & (len(rows) - n >= LEAST) & (signs[f] * (right - left) >= 0)
        gain = np.where(ok, gain, -1)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), f, k)
    return best


def fit(x: np.ndarray, y: np.ndarray, signs: list[int]) -> Trees:
    """Trees for the probability of y = 1. ``signs`` has 1 or -1 for features in which it may only rise or fall, else 0."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    total, inner, out = np.full(len(x), base), 2**DEPTH - 1, []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        feature, cut, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        nodes = {0: (np.arange(len(x)), -np.inf, np.inf)}
        for k in range(inner):
            rows, low, high = nodes.pop(k)
            left = right = (low, high)
            goes = np.zeros(len(rows), bool)
            gain, f, b = _best_split(binned, grad, hess, rows, signs, low, high) if len(rows) else (0, -1, -1)
            if f >= 0:
                feature[k], cut[k] = f, edges[f][b]
                goes = binned[rows, f] > b
                if signs[f]:
                    # What both sides may reach is parted between them, so that deeper splits keep the order.
                    values = [np.clip(-grad[r].sum() / (hess[r].sum() + L2), low, high) for r in (rows[~goes], rows[goes])]
                    middle = sum(values) / 2
                    left, right = ((low, middle), (middle, high)) if signs[f] > 0 else ((middle, high), (low, middle))
            nodes[2 * k + 1], nodes[2 * k + 2] = (rows[~goes], *left), (rows[goes], *right)
        for k, (rows, low, high) in nodes.items():
            leaf[k - inner] = RATE * np.clip(-grad[rows].sum() / (hess[rows].sum() + L2), low, high) if len(rows) else 0.0
            total[rows] += leaf[k - inner]
        out.append((feature, cut, leaf))
    return Trees(base, *(np.array(part) for part in zip(*out, strict=True)))
