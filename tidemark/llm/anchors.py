"""Content-defined regions of a byte array, in numpy: every window of 50 bytes belongs to exactly one.

A window's anchor is the least hash among its strings of ``K`` bytes; it depends on the window alone. A region
is a run of neighbouring windows with the same anchor, of at most ``RUN``. Equal windows have equal anchors.
"""

from __future__ import annotations

import numpy as np

WINDOW = 50
K = 20
_PER = WINDOW - K + 1  # strings of K bytes in a window
RUN = 31  # windows in a region at most: one bit each in a mask
_STEP = 1 << 16

_M = np.uint64(0xD6E8FEB86659FD95)
_MINV = np.uint64(pow(0xD6E8FEB86659FD95, -1, 1 << 64))
_BYTES = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_N = _STEP + WINDOW
_POW, _INV = _powers(_M, _N + 1), _powers(_MINV, _N + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _slide(x: np.ndarray, n: int, op) -> np.ndarray:
    """``op`` over each run of ``n`` neighbours, by doubling."""
    size = 1
    while size * 2 <= n:
        x = op(x[: len(x) - size], x[size:])
        size *= 2
    return x if size == n else op(x[: len(x) - (n - size)], x[n - size :])


def find(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Regions of the documents ``data[start:end]`` (in order, side by side).

    Returns, per region: first byte, number of windows, anchor, hash of the bytes, document index.
    """
    parts = []
    for at in range(0, max(len(data) - WINDOW + 1, 0), _STEP):
        seg = data[at : at + _STEP + WINDOW - 1]
        m = len(seg)
        total = np.zeros(m + 1, np.uint64)
        np.cumsum(_BYTES[seg] * _POW[:m], out=total[1:])
        h = mix((total[K:] - total[:-K]) * _INV[: m - K + 1]) | np.uint64(1)
        least = _slide(h, _PER, np.minimum)  # by the window's first byte
        first, last = np.searchsorted(end, at, "right"), np.searchsorted(start, at + m, "left")
        for e in end[first:last]:  # windows that leave their document do not count
            least[max(e - at - WINDOW + 1, 0) : max(e - at, 0)] = 0
        cut = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1], [True]]))
        left, count = cut[:-1], np.diff(cut)
        left, count = left[least[left] > 0], count[least[left] > 0]
        if len(count) and count.max() > RUN:
            pieces = -(-count // RUN)
            number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            left, count = np.repeat(left, pieces) + number * RUN, np.minimum(np.repeat(count, pieces) - number * RUN, RUN)
        region = (total[left + count + WINDOW - 1] - total[left]) * _INV[left]
        doc = np.searchsorted(end, left + at, "right")
        parts.append((left + at, count, mix(least[left]), mix(region ^ mix(count.astype(np.uint64))), doc))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def order_by(anchor: np.ndarray, region: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Order by anchor, region and document; only ties of the anchor take the slower sort."""
    order = np.argsort(anchor)
    ordered = anchor[order]
    same = ordered[1:] == ordered[:-1]
    tied = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]])) if len(order) else order
    own = order[tied]
    order[tied] = own[np.lexsort((doc[own], region[own], anchor[own]))]
    return order
