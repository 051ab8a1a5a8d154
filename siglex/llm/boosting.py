"""Small gradient-boosted trees for the logistic loss, on binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth: feature and threshold of each inner node, value of each leaf."""

    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, 2**depth)
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of every row."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, l2: float = 1.0) -> Trees:
    """Newton boosting with quantile bins; ties go to the first feature and bin."""
    share = float(np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3))
    margin = np.full(len(y), np.log(share / (1 - share)))
    start = float(margin[0]) if len(margin) else 0.0
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    width = max(map(len, edges)) + 1
    binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)  # value <= edge: left
    flat = binned + np.arange(x.shape[1]) * width
    inner = 2**depth - 1
    features, thresholds, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 2**depth))
    for n in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            cells = count * x.shape[1] * width
            index = ((at - first) * (x.shape[1] * width))[:, None] + flat
            sums = [np.bincount(index.ravel(), np.repeat(v, x.shape[1]), cells).reshape(count, x.shape[1], width) for v in (g, h)]
            left = [np.cumsum(s, 2)[:, :, :-1] for s in sums]
            total = [s.sum(2, keepdims=True) for s in sums]
            gain = left[0] ** 2 / (left[1] + l2) + (total[0] - left[0]) ** 2 / (total[1] - left[1] + l2) - total[0] ** 2 / (total[1] + l2)
            best = gain.reshape(count, -1).argmax(1)
            for k in range(count):
                f, b = divmod(int(best[k]), width - 1)
                if b < len(edges[f]) and gain[k, f, b] > 1e-9:
                    features[n, first + k], thresholds[n, first + k] = f, edges[f][b]
            at = 2 * at + 1 + (x[np.arange(len(x)), features[n, at]] > thresholds[n, at])
        at -= inner
        leaves[n] = -rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + l2)
        margin += leaves[n][at]
    return Trees(features, thresholds, leaves, start)
