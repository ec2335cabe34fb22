"""Suffix arrays in numpy: Larsson-Sadakane refinement, and Kasai's common prefixes."""

from __future__ import annotations

import numpy as np


def suffix_array(first: np.ndarray, step: int = 1) -> np.ndarray:
    """The order of the suffixes of a sequence.

    ``first`` holds for each position a number that orders its first ``step`` symbols. Each round
    doubles the length by which suffixes are ordered: it sorts only groups that still tie, by the
    rank of the suffix ``step`` later. What follows the end counts as larger than any symbol, in
    ``first`` as well.
    """
    n = len(first)
    order = np.argsort(first, kind="stable")
    rank = np.empty(n, np.int64)
    ordered = first[order]
    heads = np.ones(n, bool)
    heads[1:] = ordered[1:] != ordered[:-1]
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    while step < n:
        begins = np.flatnonzero(heads)
        sizes = np.diff(np.append(begins, n))
        tied = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(tied):
            break
        at = order[tied]
        later = np.full(len(at), n, np.int64)
        inside = at + step < n
        later[inside] = rank[at[inside] + step]
        key = rank[at] << 32 | later
        again = np.argsort(key)
        at, key = at[again], key[again]
        order[tied] = at
        fresh = np.ones(len(at), bool)
        fresh[1:] = key[1:] != key[:-1]
        heads[tied] = fresh
        rank[at] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        step *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, begins: np.ndarray, ends: np.ndarray, limit: int) -> np.ndarray:
    """For each place in ``order``, how many symbols its suffix shares with the one before, up to ``limit``.

    Kasai: the suffix one position later shares at most one symbol less, so that a comparison goes
    on where the last one stopped. The pieces ``[begins, ends)`` of the text are worked on side by
    side; a common prefix never passes the end of a piece (``text`` has a separator of 255 there).
    """
    n = len(text)
    before = np.full(n + 1, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int16)
    size = np.zeros(len(begins), np.int64)
    lengths = ends - begins
    padded = np.append(text, np.full(limit + 1, 255, text.dtype))
    for j in range(int(lengths.max()) if len(lengths) else 0):
        lane = np.flatnonzero(lengths > j)
        at = begins[lane] + j
        other = before[at]
        size[lane[other < 0]] = 0
        lane, at, other = lane[other >= 0], at[other >= 0], other[other >= 0]
        size[lane] = np.maximum(size[lane] - 1, 0)
        going = np.arange(len(lane))
        while len(going):
            k = size[lane[going]]
            mine = padded[at[going] + k]
            going = going[(mine == padded[other[going] + k]) & (mine != 255) & (k < limit)]
            size[lane[going]] += 1
        shared[at] = size[lane]
    return shared[order]
