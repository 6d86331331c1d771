"""Gradient-boosted regression trees for the logistic loss, for bounded training sets."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    """Complete trees of one depth: ``feature`` and ``cut`` by node, ``value`` by leaf, a row for each tree."""

    depth: int
    base: float = 0.0
    feature: list = field(default_factory=list)
    cut: list = field(default_factory=list)
    value: list = field(default_factory=list)

    def _leaves(self, x: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        return node - (2**self.depth - 1)

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            out += value[self._leaves(x, feature, cut)]
        return out


def _best_cut(x: np.ndarray, g: np.ndarray, h: np.ndarray, least: float) -> tuple[int, float]:
    best, found = 1e-9, (0, np.inf)
    total_g, total_h = g.sum(), h.sum()
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v = x[order, f]
        sums_g, sums_h = np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
        at = np.flatnonzero((v[1:] > v[:-1]) & (sums_h > least) & (total_h - sums_h > least))
        if len(at):
            gain = sums_g[at] ** 2 / (sums_h[at] + 1) + (total_g - sums_g[at]) ** 2 / (total_h - sums_h[at] + 1) - total_g**2 / (total_h + 1)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = gain[k], (f, (v[at[k]] + v[at[k] + 1]) / 2)
    return found


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: float = 1.0) -> BoostedTrees:
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = BoostedTrees(depth, float(np.log(share / (1 - share))))
    margin = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == k)
                if len(rows) > 1:
                    feature[k], cut[k] = _best_cut(x[rows], g[rows], h[rows], least)
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - (2**depth - 1)
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + 1)
        model.feature.append(feature)
        model.cut.append(cut)
        model.value.append(value)
        margin += value[leaf]
    return model
