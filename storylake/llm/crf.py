"""A linear-chain conditional random field with two labels, over many sequences at once.

Label 1 of an item scores ``features . weights + bias`` over label 0; every step
adds ``transition[before, after]``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class ChainModel:
    weights: np.ndarray
    bias: float
    transition: np.ndarray


def _layout(lengths: np.ndarray):
    """Sequences by falling length; for each step the items of the sequences that reach it."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    ordered = lengths[order]
    active = [int(np.searchsorted(-ordered, -t, "left")) for t in range(int(ordered[0]) if len(ordered) else 0)]
    return starts, active


def marginals(scores: np.ndarray, lengths: np.ndarray, transition: np.ndarray, with_pairs: bool = False):
    """Probability of label 1 of every item by forward-backward; with the expected transition counts if asked.

    ``scores`` holds the sequences one after another, ``lengths`` their sizes
    (zero allowed). Messages are normalised at every step, so length is no limit.
    """
    starts, active = _layout(lengths)
    local = np.ones((len(scores), 2))
    clipped = np.clip(scores, -30, 30)
    local[:, 1] = np.exp(np.minimum(clipped, 0))
    local[:, 0] = np.exp(np.minimum(-clipped, 0))
    step = np.exp(transition - transition.max())
    forward = np.empty_like(local)
    for t, n in enumerate(active):
        at = starts[:n] + t
        message = local[at] if t == 0 else local[at] * (forward[at - 1] @ step)
        forward[at] = message / message.sum(axis=1, keepdims=True)
    backward = np.ones_like(local)
    for t in range(len(active) - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        message = (local[at + 1] * backward[at + 1]) @ step.T
        backward[at] = message / message.sum(axis=1, keepdims=True)
    both = forward * backward
    result = both[:, 1] / both.sum(axis=1)
    if not with_pairs:
        return result
    expected = np.zeros((2, 2))
    for t in range(1, len(active)):
        at = starts[: active[t]] + t
        pair = forward[at - 1][:, :, None] * step[None] * (local[at] * backward[at])[:, None, :]
        expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return result, expected


def fit(x: np.ndarray, labels: np.ndarray, lengths: np.ndarray, item_weights: np.ndarray, rounds: int = 150, rate: float = 0.05, penalty: float = 1e-3) -> ChainModel:
    """Maximum likelihood by Adam; ``item_weights`` balance the labels in the local terms."""
    starts = np.cumsum(lengths) - lengths
    inner = np.ones(len(labels), bool)
    inner[starts[lengths > 0]] = False
    after = np.flatnonzero(inner)
    observed = np.zeros((2, 2))
    np.add.at(observed, (labels[after - 1], labels[after]), 1)
    theta, m, v = np.zeros(x.shape[1] + 5), np.zeros(x.shape[1] + 5), np.zeros(x.shape[1] + 5)
    total = item_weights.sum()
    for i in range(1, rounds + 1):
        transition = theta[-4:].reshape(2, 2)
        p, expected = marginals(x @ theta[:-5] + theta[-5], lengths, transition, with_pairs=True)
        error = item_weights * (p - labels)
        slope = np.concatenate([x.T @ error / total, [error.sum() / total], ((expected - observed) / max(1, len(after))).ravel()])
        slope[:-5] += penalty * theta[:-5]
        slope[-4:] += penalty * theta[-4:]
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta = theta - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return ChainModel(theta[:-5], float(theta[-5]), theta[-4:].reshape(2, 2))
