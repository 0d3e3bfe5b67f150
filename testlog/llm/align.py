"""Banded edit distance of two token sequences, one bit per cell of the band.

A column of the distance table is held as two integers of one bit per row: where it
goes up and where it goes down.  Only rows within ``limit`` of the diagonal are held,
and the window moves one row down with every column (bit-parallel dynamic programming
after Myers and Hyyro).
"""

from __future__ import annotations

from collections import Counter

import numpy as np


def _trim(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the common start and the common end."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    return a[: len(a) - tail], b[: len(b) - tail]


def banded_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Insertions, deletions and substitutions between ``a`` and ``b``; limit + 1 if more."""
    a, b = _trim(a, b)
    if len(a) < len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if m - n > limit:
        return limit + 1
    if n == 0:
        return m
    # a word without a partner costs an edit at least
    if m - sum((Counter(a.tolist()) & Counter(b.tolist())).values()) > limit:
        return limit + 1
    limit_here = min(limit, m)
    width = 2 * limit_here + 2
    mask = (1 << width) - 1
    top = width - 1
    places: dict[int, int] = {}
    for i, token in enumerate(a.tolist()):
        places[token] = places.get(token, 0) | (1 << i)
    up = mask ^ ((1 << (width - limit_here - 1)) - 1)
    down = 0
    # distance in the lowest row of the band, later in the last row of the table
    score = limit_here
    row_bit = 1 << (top - 1)
    worst = 2 * limit_here + n - m
    shift = limit_here + 1 - width
    slanted = m - limit_here
    for j, token in enumerate(b.tolist()):
        same = places.get(token, 0)
        if same:
            same = (same >> shift if shift >= 0 else same << -shift) & mask
        flat = ((((same & up) + up) ^ up) | same | down) & mask
        over = (down | ~(flat | up)) & mask
        under = flat & up
        if j < slanted:
            score += not flat >> top & 1
        else:
            score += bool(over & row_bit)
            score -= bool(under & row_bit)
            row_bit >>= 1
        if score > worst:
            return limit + 1
        flat >>= 1
        up = (under | ~(flat | over)) & mask
        down = flat & over
        shift += 1
    return score if score <= limit else limit + 1


def similarity(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """1 - distance / longer length where that reaches ``threshold``, else 0."""
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    limit = int((1.0 - threshold) * longer + 1e-9)
    distance = banded_distance(a, b, limit)
    return 1.0 - distance / longer if distance <= limit else 0.0
