"""Vectorised 64-bit hashing on numpy arrays."""

from __future__ import annotations

import numpy as np

U = np.uint64
STEP = U(0x9E3779B97F4A7C15)  # odd, so multiplying by it loses nothing


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every input bit moves every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    """Doubles in (0, 1] from the high bits of ``x``."""
    return ((x >> U(11)).astype(np.float64) + 1.0) * 2.0**-53
