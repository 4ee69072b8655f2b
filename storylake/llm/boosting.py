"""Gradient-boosted trees for small tables of numeric features (logistic loss), in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DEPTH = 3


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _grow(x, slope, curve, rows, depth, tree, at, rate, penalty):
    """Grow one node: the split of the best gain, or a leaf."""
    g, h = slope[rows].sum(), curve[rows].sum()
    best = (1e-6, None, None)
    if depth:
        for feature in range(x.shape[1]):
            values = x[rows, feature]
            cuts = np.unique(values)
            if len(cuts) < 2:
                continue
            cuts = (cuts[1:] + cuts[:-1]) / 2
            if len(cuts) > 32:
                cuts = cuts[np.linspace(0, len(cuts) - 1, 32).astype(int)]
            side = np.searchsorted(cuts, values, "left")
            gl = np.cumsum(np.bincount(side, slope[rows], len(cuts) + 1))[:-1]
            hl = np.cumsum(np.bincount(side, curve[rows], len(cuts) + 1))[:-1]
            gain = gl**2 / (hl + penalty) + (g - gl) ** 2 / (h - hl + penalty) - g**2 / (h + penalty)
            if gain.max() > best[0]:
                best = (gain.max(), feature, cuts[gain.argmax()])
    if best[1] is None:
        tree[at] = (-1, 0.0, -rate * g / (h + penalty))
        return
    tree[at] = (best[1], best[2], 0.0)
    left = x[rows, best[1]] <= best[2]
    _grow(x, slope, curve, rows[left], depth - 1, tree, 2 * at + 1, rate, penalty)
    _grow(x, slope, curve, rows[~left], depth - 1, tree, 2 * at + 2, rate, penalty)


@dataclass(frozen=True)
class BoostedTrees:
    """Trees as arrays: node ``i`` has children ``2i+1`` and ``2i+2``; feature -1 marks a leaf."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                inner = feature[at] >= 0
                right = x[rows, np.maximum(feature[at], 0)] > cut[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            total += value[at]
        return total


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.3, penalty: float = 1.0) -> BoostedTrees:
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base, score, trees = float(np.log(share / (1 - share))), None, []
    score = np.full(len(y), base)
    for _ in range(rounds):
        p = _sigmoid(score)
        tree = {}
        _grow(x, p - y, p * (1 - p), np.arange(len(y)), DEPTH, tree, 0, rate, penalty)
        size = 2 ** (DEPTH + 1) - 1
        nodes = [tree.get(i, (-1, 0.0, 0.0)) for i in range(size)]
        trees.append(nodes)
        model = BoostedTrees(0.0, *_arrays([nodes]))
        score = score + model.margin(x)
    return BoostedTrees(base, *_arrays(trees))


def _arrays(trees):
    part = lambda i, kind: np.array([[n[i] for n in t] for t in trees], kind)
    return part(0, int), part(1, float), part(2, float)


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """``(a, b)`` such that ``sigmoid(a * margin + b)`` is a calibrated probability."""
    a, b = 1.0, 0.0
    for _ in range(steps):  # Newton steps, damped
        p = _sigmoid(a * margin + b)
        w = p * (1 - p) + 1e-6
        ga, gb = ((p - y) * margin).mean() + 1e-3 * (a - 1), (p - y).mean()
        haa, hab, hbb = (w * margin * margin).mean() + 1e-3, (w * margin).mean(), w.mean() + 1e-6
        det = haa * hbb - hab * hab
        a, b = a - 0.5 * (hbb * ga - hab * gb) / det, b - 0.5 * (haa * gb - hab * ga) / det
    return float(a), float(b)
