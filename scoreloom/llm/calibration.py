"""Logistic calibration of a classifier's margins."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def calibrate(margins: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve over the margins, with smoothed targets and both labels weighing
    alike; the slope stays positive."""
    if labels.min() == labels.max():
        return 1.0, 0.0
    n_pos, n_neg = labels.sum(), (1 - labels).sum()
    target = np.where(labels > 0, (n_pos + 1) / (n_pos + 2), 1 / (n_neg + 2))
    weight = np.where(labels > 0, 0.5 * len(labels) / n_pos, 0.5 * len(labels) / n_neg)
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * margins + b)
        g, w = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(w * margins * margins).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, np.array([(g * margins).sum() + 1e-3 * (a - 1), g.sum()]))
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
    return max(float(a), 0.05), float(b)


def calibrate_at(margins: np.ndarray, labels: np.ndarray, threshold: float, clean_weight: float = 3.0) -> tuple[float, float]:
    """As ``calibrate``, shifted so that ``threshold`` is met at the best cut: the one with the greatest true positive
    rate less ``clean_weight`` times the false positive rate, in the middle between the margins beside it."""
    a, b = calibrate(margins, labels)
    if labels.min() == labels.max():
        return a, b
    order = np.argsort(-margins, kind="stable")
    m, y = margins[order], labels[order]
    gain = np.cumsum(y) / y.sum() - clean_weight * np.cumsum(1 - y) / (1 - y).sum()
    last = np.append(m[1:] < m[:-1], True)  # equal margins fall on one side
    gain[~last] = -np.inf
    k = int(np.argmax(gain))
    if gain[k] <= 0:  # no cut is better than none: nothing seen here meets the threshold
        return a, float(np.log(threshold / (1 - threshold)) - a * (m[0] + 1e-6))
    cut = (m[k] + m[k + 1]) / 2 if k + 1 < len(m) else m[k] - 1e-6
    return a, float(np.log(threshold / (1 - threshold)) - a * cut)
