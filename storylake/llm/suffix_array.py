"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays.

The usual induced sort reads the suffix array once from each side and appends
the suffix before the one it reads to a bucket. All suffixes of a bucket can be
read at once, since what they append lands in later buckets or, for a run of one
symbol, in a next wave of the same bucket; so every step here is an array
operation on a wave.
"""

from __future__ import annotations

import numpy as np


def types(s: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the one after them (S), False for larger ones (L); the last is L."""
    n = len(s)
    falls = np.zeros(n, np.int8)
    falls[:-1] = np.sign(s[1:].astype(np.int64) - s[:-1].astype(np.int64))
    falls[-1] = -1
    nearest = np.where(falls != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    return falls[nearest] > 0


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Suffix array in which ``lms`` (in order within each bucket) has induced all other suffixes."""
    n, symbols = len(s), np.flatnonzero(np.diff(bounds))
    sa = np.full(n, -1, np.int64)
    head, tail = bounds[:-1].copy(), bounds[1:].copy()
    # Few symbols sort faster in a short type.
    s = s.astype(np.uint16) if len(bounds) <= 1 << 16 else s
    after_small, after_large = np.zeros(n, bool), np.zeros(n, bool)
    after_small[1:], after_large[1:] = small[:-1], ~small[:-1]
    index = np.arange(n)
    first = s[lms]
    order = np.argsort(first, kind="stable")
    lms, first = lms[order], first[order]
    lms_bounds = np.searchsorted(first, np.arange(len(bounds)))

    def place(at, forward):
        """Append suffixes to their buckets, in order; from the front or the back."""
        c = s[at]
        order = c.argsort(kind="stable")
        at, c = at[order], c[order]
        number = index[: len(c)] - c.searchsorted(c)
        # Of assignments to one bucket's end the last one stays, which is that of its last suffix.
        if forward:
            slot = head[c] + number
            head[c] = slot + 1
        else:
            slot = tail[c] - 1 - number
            tail[c] = slot
        sa[slot] = at

    place(np.array([n - 1]), True)
    for c in symbols.tolist():
        done = bounds[c]
        while done < head[c]:
            wave, done = sa[done : head[c]], head[c]
            before = wave[after_large[wave]] - 1
            if len(before):
                place(before, True)
        mine = lms[lms_bounds[c] : lms_bounds[c + 1]]
        if len(mine):
            place(mine[after_large[mine]] - 1, True)
    for c in symbols[::-1].tolist():
        done = bounds[c + 1]
        while done > tail[c]:
            wave, done = sa[tail[c] : done][::-1], tail[c]
            before = wave[after_small[wave]] - 1
            if len(before):
                place(before, False)
        large = sa[bounds[c] : head[c]][::-1]
        before = large[after_small[large]] - 1
        if len(before):
            place(before, False)
    return sa


def _names(s: np.ndarray, small: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the leftmost-smaller substrings in text order, equal substrings alike, and their number."""
    index = np.zeros(len(s), np.int64)
    index[lms] = np.arange(len(lms))
    end = np.append(lms[1:], len(s) - 1)
    a, b = ordered[:-1], ordered[1:]
    size_a, size_b = end[index[a]] - a, end[index[b]] - b
    last = lms[-1]
    same = (size_a == size_b) & (a != last) & (b != last)
    pairs, step = np.flatnonzero(same), 0
    while len(pairs):
        x, y = a[pairs] + step, b[pairs] + step
        equal = (s[x] == s[y]) & (small[x] == small[y])
        same[pairs[~equal]] = False
        pairs = pairs[equal & (size_a[pairs] > step)]
        step += 1
    rank = np.concatenate([[0], np.cumsum(~same)])
    names = np.empty(len(lms), np.int64)
    names[index[ordered]] = rank
    return names, int(rank[-1]) + 1


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``s`` (small non-negative integers) in sorted order."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    s = s.astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(s))])
    small = types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sa = _induce(s, small, lms, bounds)
    if len(lms) > 1:
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        ordered = sa[is_lms[sa]]
        names, count = _names(s, small, lms, ordered)
        if count < len(lms):
            # Names become two digits, so that the alphabet, and with it the number of waves, stays near the root of the length.
            base = int(np.ceil(np.sqrt(count)))
            digits = np.stack([names // base, names % base], axis=1).ravel()
            deeper = suffix_array(digits)
            ordered = lms[deeper[deeper % 2 == 0] // 2]
        sa = _induce(s, small, ordered, bounds)
    return sa


def permuted_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For every position of a byte text, the common prefix with the suffix sorted before it, up to ``most``."""
    n = len(text)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    padded = np.concatenate([text, np.zeros(most + 16, np.uint8)]).astype(np.uint64)
    words = padded[: n + most + 8].copy()
    for k in range(1, 8):
        words |= padded[k : n + most + 8 + k] << np.uint64(8 * k)
    common = np.zeros(n, np.int64)
    live = np.flatnonzero(before >= 0)
    for step in range(0, most, 8):
        differ = words[live + step] ^ words[before[live] + step]
        broken = differ != 0
        low = differ[broken] & (~differ[broken] + np.uint64(1))
        common[live[broken]] = step + np.log2(low.astype(np.float64)).astype(np.int64) // 8
        live = live[~broken]
    common[live] = most
    ends = n - np.maximum(np.arange(n), before)  # nothing is shared beyond the end of the text
    return np.minimum(np.minimum(common, most), ends)
