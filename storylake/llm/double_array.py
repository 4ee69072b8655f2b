"""A double-array trie over byte strings."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


#: A search that passes over more slots than this moves the start of later ones.
SEARCH = 32


@dataclass(frozen=True)
class DoubleArray:
    """Node ``n`` has the child for byte ``b`` at ``base[n] + b`` if ``check`` there is ``n``; ``value`` is -1 but at ends of keys."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray


def build(keys: list[bytes], values: list[int]) -> DoubleArray:
    """Place every node's children at the first offset where all of them are free."""
    tree: list[dict[int, int]] = [{}]
    ends = [-1]
    for key, value in zip(keys, values):
        at = 0
        for b in key:
            if b not in tree[at]:
                tree[at][b] = len(tree)
                tree.append({})
                ends.append(-1)
            at = tree[at][b]
        ends[at] = value
    size = len(tree) * 4 + 1024
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    taken, free = bytearray(size), 1
    taken[0] = 1
    value[0] = ends[0]
    queue = [(0, 0)]
    for place, node in queue:
        children = sorted(tree[node])
        if not children:
            continue
        free = taken.index(0, free)
        at, tries = max(1, free - children[0]), 0
        while any(taken[at + b] for b in children):
            at += 1
            tries += 1
        if tries > SEARCH:  # the slots up to here are nearly full: later searches start further on
            free = at
        if at + 600 > len(taken):
            taken.extend(bytes(size))
            base, check, value = (np.concatenate([a, np.full(size, f, np.int32)]) for a, f in ((base, 0), (check, -1), (value, -1)))
        base[place] = at
        for b in children:
            taken[at + b] = 1
            check[at + b] = place
            value[at + b] = ends[tree[node][b]]
            queue.append((at + b, tree[node][b]))
    last = int(np.flatnonzero(check >= 0).max(initial=0)) + 257
    return DoubleArray(base[:last].copy(), check[:last].copy(), value[:last].copy())
