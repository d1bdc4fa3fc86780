"""Burrows-Wheeler transforms of string collections and their merge, in numpy.

A collection's strings are sorted; each ends with the symbol 0. Row order: by suffix, equal suffixes by
string. The merge never sorts suffixes: it starts from the shards' rows side by side and refines the
interleave, two symbols a round, by a stable counting sort on the symbols that precede each row.
"""

from __future__ import annotations

import numpy as np


def transform(strings: list[bytes]) -> np.ndarray:
    """BWT (symbols: byte + 1, 0 at the end) of sorted UTF-8 strings; prefix doubling over the shard's own rows."""
    text = np.frombuffer(b"\0".join(s.translate(_PLUS_ONE) for s in strings) + b"\0", np.uint8)
    ends = np.flatnonzero(text == 0)
    which = np.repeat(np.arange(len(strings)), np.diff(ends, prepend=-1))
    left = ends[which] - np.arange(len(text)) + 1  # symbols to the end, that included
    key = text.astype(np.uint64)
    for bits in (8, 16, 32):
        more = np.zeros_like(key)
        step = bits // 8
        more[:-step] = key[step:]
        more[left <= step] = 0
        key = (key << np.uint64(bits)) | more
    rank, depth = _dense(key), 8
    while depth < left.max() and rank.max() < len(text) - 1:
        more = np.zeros(len(text), np.int64)
        more[:-depth] = rank[depth:] + 1
        more[left <= depth] = 0
        rank = _dense(rank * (len(text) + 1) + more)
        depth *= 2
    order = np.argsort(rank * len(strings) + which)
    return text[order - 1]


_PLUS_ONE = bytes((i + 1) % 256 for i in range(256))


def _dense(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    ordered = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
    return rank


def merge(shards: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge shard BWTs up to ``depth`` (even) symbols.

    A row alone in its interval stays alone, and so do the rows of all longer suffixes that end with its suffix;
    such rows leave the refinement. Returns, by row of the shards side by side: number of the repeated interval
    (rows that share ``depth`` symbols; in the merged order, -1 for a row alone), row of the suffix without its
    first symbol, and the rows of whole strings.
    """
    bwt = np.concatenate(shards)
    last_to_first, base = np.empty(len(bwt), np.int32), 0
    for s in shards:
        order = np.argsort(s, kind="stable")
        last_to_first[base + order] = np.arange(base, base + len(s), dtype=np.int32)
        base += len(s)
    onward = np.empty_like(last_to_first)
    onward[last_to_first] = np.arange(len(bwt), dtype=np.int32)
    pair = (bwt[last_to_first].astype(np.uint16) << np.uint16(8)) | bwt
    twice = last_to_first[last_to_first]
    row, interval = np.arange(len(bwt), dtype=np.int32), np.zeros(len(bwt), np.int32)
    by_row = np.full(len(bwt), -1, np.int32)
    for _ in range(depth // 2):
        symbol = pair[row]
        order = np.argsort(symbol, kind="stable")
        symbol, interval = symbol[order], interval[order]
        # a common prefix ends here where the symbols or the former intervals of neighbours differ
        cut = np.concatenate([[True], (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1]), [True]])
        row, cut, shared = twice[row[order]], cut[:-1], ~(cut[:-1] & cut[1:])
        row, interval = row[shared], np.cumsum(cut[shared], dtype=np.int32) - np.int32(1)
    by_row[row] = interval
    return by_row, onward, np.flatnonzero(bwt == 0)
