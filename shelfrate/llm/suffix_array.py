"""Suffixes in the order of their first bytes, common prefixes of neighbours, and longest-previous-factor arrays."""

from __future__ import annotations

import numpy as np


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks: equal keys share a rank, smaller keys have smaller ranks."""
    order = np.argsort(keys)
    ordered = keys[order]
    out = np.empty(len(keys), np.uint64)
    out[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1]))).astype(np.uint64)
    return out


def prefix_keys(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Numbers ordered as the suffixes at ``starts`` by their first ``length`` bytes (8 at least).

    Prefix multiplying: ranks by 8 bytes, then by as many stretches of the
    last length as fit into 64 bits (three for up to two million bytes); the
    last step lets stretches overlap, so any length is reached exactly.
    Every start must have ``length`` bytes after it.
    """
    have, n = 8, len(data)
    rank = np.zeros(n - have + 1, np.uint64)
    for j in range(have):
        rank = (rank << np.uint64(8)) | data[j:n - have + 1 + j].astype(np.uint64)
    while True:
        rank = _ranks(rank)
        bits = int(rank.max()).bit_length() or 1
        parts = min(64 // bits, -(-length // have))
        last = parts * have >= length
        steps = [min(k * have, length - have) if last else k * have for k in range(parts)]
        at = starts if last else np.arange(len(rank) - steps[-1])
        key = np.zeros(len(at), np.uint64)
        for step in steps:
            key = (key << np.uint64(bits)) | rank[at + step]
        if last:
            return key
        rank, have = key, parts * have


def common_prefixes(data: np.ndarray, left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """Bytes that the suffixes at ``left`` and ``right`` share, pair by pair; ``length`` at most."""
    word = np.zeros(len(data) - 7, np.uint64)
    for j in range(8):
        word = (word << np.uint64(8)) | data[j:len(word) + j].astype(np.uint64)
    out = np.zeros(len(left), np.int64)
    going = np.arange(len(left))
    while len(going):
        step = np.minimum(out[going], length - 8)  # the last word may overlap the one before it
        differ = word[left[going] + step] ^ word[right[going] + step]
        same = differ == 0
        out[going[same]] = step[same] + 8
        # Leading equal bytes of words that differ: the exponent of the difference tells the first other byte.
        other = differ[~same]
        out[going[~same]] = step[~same] + sum((other < np.uint64(1 << (64 - 8 * k))).astype(np.int64) for k in range(1, 8))
        going = going[same]
        going = going[out[going] < length]
    return out


def _to_smaller(value: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the nearest row before it that has a smaller value; 0 without one.

    ``lcp[i]`` is the common prefix of rows i - 1 and i. A row points at the
    row before it and, while that has a larger value, goes on to where that
    row points: everything between has a larger value, so no smaller one is missed, and
    the ways double in length.
    """
    n = len(value)
    at, shared = np.arange(-1, n - 1), lcp.copy()
    going = np.arange(1, n)
    while len(going := going[(at[going] >= 0) & (value[at[going]] > value[going])]):
        over = at[going]
        shared[going], at[going] = np.minimum(shared[going], shared[over]), at[over]
    return np.where(at >= 0, shared, 0)


def previous_factors(data: np.ndarray, starts: np.ndarray, length: int,
                     later: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """For each start the length of the longest string that also begins at an earlier start, up to ``length``.

    ``starts`` are in corpus order. The previous and the next smaller
    position of a start in suffix order share the longest prefixes with it
    among all earlier starts. With ``later`` the second array holds the same
    for later starts. Suffixes are ordered by their first ``length`` bytes,
    equal ones by position.
    """
    order = np.argsort(prefix_keys(data, starts, length), kind="stable")
    lcp = np.zeros(len(order), np.int64)
    lcp[1:] = common_prefixes(data, starts[order[:-1]], starts[order[1:]], length)
    back = np.concatenate(([0], lcp[:0:-1])) if len(lcp) else lcp  # common prefixes of the order read backwards

    def longest(value: np.ndarray) -> np.ndarray:
        out = np.empty(len(value), np.int64)
        out[order] = np.maximum(_to_smaller(value, lcp), _to_smaller(value[::-1], back)[::-1])
        return out

    return longest(order), longest(-order) if later else None
