"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai common prefixes, search. Used by operators 4 and 8."""

from __future__ import annotations

import numpy as np


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank of each suffix) of an array of non-negative integers; a suffix comes before those it is a prefix of.

    Larsson and Sadakane's refinement: suffixes are sorted by their first h symbols into groups; only groups of more than one
    are sorted again, each suffix by the group of the suffix h further on, and h doubles. A group's number is its first
    place, so numbers that are final stay.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, rank = np.unique(codes, return_inverse=True)
    rank = rank.astype(np.int64)
    bits = int(n + 1).bit_length()
    packed = 3 * bits <= 64
    index = np.arange(n)
    sa = np.argsort(rank, kind="stable") if not packed else (np.sort((rank.astype(np.uint64) << np.uint64(bits)) | index.astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int64)
    sorted_rank = rank[sa]
    head = np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]])
    group = np.maximum.accumulate(np.where(head, index, 0))
    rank[sa] = group
    h = 1
    open_ = np.flatnonzero(~(head & np.concatenate([head[1:], [True]])))
    while len(open_):
        at = sa[open_]
        mine = rank[at]
        ahead = at + h
        other = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        if packed:
            key = (mine.astype(np.uint64) << np.uint64(2 * bits)) | (other.astype(np.uint64) << np.uint64(bits)) | at.astype(np.uint64)
            key.sort()
            at = (key & np.uint64((1 << bits) - 1)).astype(np.int64)
            pair = key >> np.uint64(bits)
            head = np.concatenate([[True], pair[1:] != pair[:-1]])
        else:
            order = np.lexsort((at, other, mine))
            at, mine, other = at[order], mine[order], other[order]
            head = np.concatenate([[True], (mine[1:] != mine[:-1]) | (other[1:] != other[:-1])])
        sa[open_] = at  # groups keep their places, in order
        rank[at] = np.maximum.accumulate(np.where(head, open_, 0))
        open_ = open_[~(head & np.concatenate([head[1:], [True]]))]
        h *= 2
    return sa, rank


def kasai(codes: np.ndarray, sa: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each place in the suffix array, the length of the common prefix with the suffix in the place before (0 for the first).

    Kasai's observation, in text order: where a suffix and its predecessor in the array are preceded by the same symbol, the
    common prefix is the one of the position before, less one. Only the other positions are compared, symbol by symbol, all
    of them in step; the rest follows from them.
    """
    n = len(codes)
    if n < 2:
        return np.zeros(n, np.int64)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    index = np.arange(n)
    follows = (index > 0) & (before > 0)
    follows[1:] &= codes[:-1] == codes[np.maximum(before[1:] - 1, 0)]
    own = np.flatnonzero(~follows)
    length = np.zeros(n, np.int64)
    live = own[before[own] >= 0]
    step = 0
    while len(live):
        a, b = live + step, before[live] + step
        same = (a < n) & (b < n)
        same[same] = codes[a[same]] == codes[b[same]]
        live = live[same]
        length[live] += 1
        step += 1
    last = np.maximum.accumulate(np.where(follows, 0, index))
    length = np.maximum(length[last] - (index - last), 0)
    length[before < 0] = 0
    out = np.zeros(n, np.int64)
    out[rank] = length
    return out


def narrow(codes: np.ndarray, sa: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search, for many ranges [low, high) of a suffix array at once: the part whose symbol at this depth is the given one."""
    n = len(codes)

    def bound(after: bool) -> np.ndarray:
        lo, hi = low.copy(), high.copy()
        while True:
            live = np.flatnonzero(lo < hi)
            if not len(live):
                return lo
            mid = (lo[live] + hi[live]) // 2
            at = sa[mid] + depth
            here = np.where(at < n, codes[np.minimum(at, n - 1)], -1)
            less = here <= symbol[live] if after else here < symbol[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)

    return bound(False), bound(True)
