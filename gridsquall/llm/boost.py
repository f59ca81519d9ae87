"""Gradient-boosted trees for a binary label, on histograms of binned features."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


@dataclass
class Trees:
    """Complete binary trees of one depth; a node sends values over its cut to the right."""

    depth: int
    bias: float
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            z += v[at - len(f)]
        return z


def train(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 4, rate: float = 0.2, smooth: float = 2.0) -> Trees:
    """Second-order boosting of log loss."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    b = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)], 1)
    mean = np.clip(y.mean(), 0.01, 0.99)
    model = Trees(depth, float(np.log(mean / (1 - mean))))
    z = np.full(n, model.bias)
    inner = (1 << depth) - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        f, c, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        bin_cut = np.full(inner, BINS)
        for level in range(depth):
            first = (1 << level) - 1
            k = 1 << level
            best = np.full(k, 1e-6)
            for j in range(m):
                slot = (at - first) * BINS + b[:, j]
                sg = np.bincount(slot, g, k * BINS).reshape(k, BINS)
                sh = np.bincount(slot, h, k * BINS).reshape(k, BINS)
                lg, lh = np.cumsum(sg, 1)[:, :-1], np.cumsum(sh, 1)[:, :-1]
                tg, th = sg.sum(1, keepdims=True), sh.sum(1, keepdims=True)
                gain = lg**2 / (lh + smooth) + (tg - lg) ** 2 / (th - lh + smooth) - tg**2 / (th + smooth)
                gain[:, len(edges[j]) :] = -1
                top = gain.argmax(1)
                value = gain[np.arange(k), top]
                for i in np.flatnonzero(value > best + 1e-12):
                    best[i], f[first + i], bin_cut[first + i], c[first + i] = value[i], j, top[i], edges[j][top[i]]
            at = 2 * at + 1 + (b[np.arange(n), f[at]] > bin_cut[at])
        leaf_of = at - inner
        leaf = -rate * np.bincount(leaf_of, g, inner + 1) / (np.bincount(leaf_of, h, inner + 1) + smooth)
        z += leaf[leaf_of]
        model.feature.append(f)
        model.cut.append(c)
        model.leaf.append(leaf)
    return model
