"""Weighted MinHash by throwing darts (DartMinHash, Christiani 2020).

Every element of a weighted set owns a region: its weight by the rank axis.
Hash functions of the element alone throw darts into that region, one per unit
of area on average. Each dart also carries one of ``k`` coordinates, and the
earliest dart (least rank) of a coordinate is its signature value. Two sets
agree in a coordinate with probability equal to their weighted Jaccard
similarity, and about ``k ln k`` darts a set are enough, however many elements
it has.

Weights are cut into strips one unit wide. In a strip, ranks of darts follow
one another at exponential distances, so the darts below any rank are the same
whatever rank the throwing stops at.
"""

from __future__ import annotations

import numpy as np

from storylake.llm.hashing import STEP, U, mix, uniform


def first_reach(coordinates: int) -> float:
    """Expected darts a set at the first try: enough that a coordinate is rarely left empty."""
    return coordinates * np.log(coordinates) + 2 * coordinates


def _strips(elements: np.ndarray, weights: np.ndarray, owners: np.ndarray):
    """Unit-wide strips of the elements' regions: hash, part of the width that counts, owner."""
    count = np.ceil(weights).astype(np.int64)
    at = np.repeat(np.arange(len(elements)), count)
    number = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    keys = mix(elements[at] + number.astype(U) * STEP)
    return keys, np.minimum(1.0, weights[at] - number), owners[at]


def signatures(elements: np.ndarray, weights: np.ndarray, owners: np.ndarray, sets: int, coordinates: int) -> np.ndarray:
    """Signatures of ``sets`` weighted sets, as a ``sets`` by ``coordinates`` array of hashes.

    ``elements`` are 64-bit hashes, ``weights`` positive, ``owners`` in
    ``range(sets)``. A set without elements gets zeros.
    """
    keys, width, strip_owner = _strips(elements, weights, owners)
    total = np.bincount(owners, weights, sets)
    result = np.zeros((sets, coordinates), U)
    todo, reach = total > 0, first_reach(coordinates)
    while todo.any():
        mine = todo[strip_owner]
        state, live_owner, part = keys[mine], strip_owner[mine], width[mine]
        limit, rank = (reach / total[live_owner]), np.zeros(len(state))
        ranks, slots, names = [], [], []
        while len(state):
            state = mix(state + STEP)
            rank = rank - np.log(uniform(state))
            below = rank < limit
            state, rank, live_owner, part, limit = state[below], rank[below], live_owner[below], part[below], limit[below]
            name = mix(state ^ U(0xD1B54A32D192ED03))
            hit = slice(None) if (part >= 1).all() else uniform(mix(name + STEP)) <= part
            ranks.append(rank[hit])
            names.append(name[hit])
            slots.append(live_owner[hit] * coordinates + ((name[hit] >> U(32)) * U(coordinates) >> U(32)).astype(np.int64))
        rank, slot, name = np.concatenate(ranks), np.concatenate(slots), np.concatenate(names)
        least = np.full(sets * coordinates, np.inf)
        np.minimum.at(least, slot, rank)
        first = rank == least[slot]
        found = np.zeros(sets * coordinates, U)
        found[slot[first]] = name[first]
        full = np.isfinite(least).reshape(sets, coordinates).all(axis=1) & todo
        result[full] = found.reshape(sets, coordinates)[full]
        todo &= ~full
        reach *= 2  # a coordinate without a dart: throw on, to twice the rank
    return result


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One hash for each run of ``coordinates / bands`` values; equal keys mean equal runs of one band."""
    sets, coordinates = signature.shape
    rows = coordinates // bands
    keys = np.zeros((sets, bands), U) + mix(np.arange(1, bands + 1, dtype=U))
    for row in range(rows):
        keys = mix(keys * STEP + signature[:, row : bands * rows : rows])
    return keys
