"""Gradient-boosted trees for a 0/1 label, on binned features, in NumPy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Trees of equal depth in heap order: node n asks ``x[feature] > cut`` and goes to 2n + 1 or 2n + 2."""

    start: float
    features: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        by_feature = np.ascontiguousarray(x.T)
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int8)
            first = 0
            while first < len(feature):
                # All questions of a level are put to all rows: cheaper than fetching each row's own.
                right = np.zeros(len(x), dtype=bool)
                for n in range(first + 1):
                    right |= (node == n) & (by_feature[feature[first + n]] > cut[first + n])
                node = (2 * node + right).astype(np.int8)
                first = 2 * first + 1
            total += leaf[node]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(
    x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0
) -> Boosted:
    """Newton boosting of the logistic loss; a node takes the cut with the greatest gain of all bins."""
    share = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
    model = Boosted(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)))[:-1] for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    width = max(len(e) for e in edges) + 1
    margin = np.full(len(y), model.start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        inner = 2**depth - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            gains = np.zeros((x.shape[1], count, width))
            for j in range(x.shape[1]):
                cell = (node - first) * width + binned[:, j]
                g = np.bincount(cell, weights=slope, minlength=count * width).reshape(count, width)
                h = np.bincount(cell, weights=curve, minlength=count * width).reshape(count, width)
                gl, hl = np.cumsum(g, axis=1), np.cumsum(h, axis=1)
                gr, hr = gl[:, -1:] - gl, hl[:, -1:] - hl
                gains[j] = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gl[:, -1:] ** 2 / (hl[:, -1:] + ridge)
                gains[j, :, len(edges[j]) :] = 0
            for n in range(count):
                j, b = np.unravel_index(np.argmax(gains[:, n]), (x.shape[1], width))
                if gains[j, n, b] > 1e-9:
                    feature[first + n], cut[first + n] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - inner
        g = np.bincount(leaf, weights=slope, minlength=2**depth)
        h = np.bincount(leaf, weights=curve, minlength=2**depth)
        values = -rate * g / (h + ridge)
        margin += values[leaf]
        model.features.append(feature)
        model.cuts.append(cut)
        model.leaves.append(values)
    return model


def threshold(probability: np.ndarray, label: np.ndarray, precision: float) -> float:
    """The least threshold from which on every higher one keeps the wanted precision; over 1 if none does."""
    order = np.argsort(-probability, kind="stable")
    right = np.cumsum(label[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(np.minimum.accumulate(right) >= precision) if len(order) else order
    last = np.append(np.diff(probability[order]) != 0, True)
    good = good[last[good]] if len(good) else good
    return float(probability[order[good[-1]]]) if len(good) else 2.0
