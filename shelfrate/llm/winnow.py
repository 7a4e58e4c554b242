"""Winnowing: anchors such that equal windows always share an equal anchor.

A window of L symbols holds L - K + 1 grams of K symbols; its anchor is the
gram with the smallest hash, the rightmost one of equals. The choice depends
on the content of the window only, so two equal windows have equal grams at
the same distance from their starts, and comparing the windows of equal
anchors finds every repeated window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from shelfrate.llm.tokens import mix, prefix_sums, stretch_hash

_LOW = np.uint64(24)
_MASK = np.uint64((1 << 24) - 1)
# Windows handled at a time; below 2**24, which the position bits can number.
SPAN = 1 << 19


@dataclass
class Runs:
    """Anchors: document index, position, window starts first..last that have it, gram and context hashes."""
    doc: np.ndarray
    pos: np.ndarray
    first: np.ndarray
    last: np.ndarray
    gram: np.ndarray
    context: np.ndarray

    @staticmethod
    def join(parts: list[Runs]) -> Runs:
        cols = [np.concatenate([getattr(p, f) for p in parts]) for f in Runs.__dataclass_fields__]
        return Runs(*cols)

    def take(self, index: np.ndarray) -> Runs:
        return Runs(*[getattr(self, f)[index] for f in Runs.__dataclass_fields__])


def _none() -> Runs:
    i, u = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return Runs(i, i, i, i, u, u)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, in time linear in the length."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def _runs(values: np.ndarray, at: np.ndarray, length: int, gram: int) -> Runs:
    """Anchors of several texts laid end to end; text i is values[at[i]:at[i + 1]]."""
    n, width = len(values), length - gram + 1
    if n < length:
        return _none()
    sums = prefix_sums(values)
    i = np.arange(n - gram + 1)
    hashes = stretch_hash(sums, i, i + gram)
    key = (hashes >> _LOW << _LOW) | (_MASK - i.astype(np.uint64))
    chosen = (_MASK - (_sliding_min(key, width) & _MASK)).astype(np.int64)
    end = np.repeat(at[1:], np.diff(at))
    starts = np.flatnonzero(np.arange(n - length + 1) + length <= end[:n - length + 1])
    if not len(starts):
        return _none()
    p = chosen[starts]
    new = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
    until = np.concatenate((new[1:], [len(p)])) - 1
    pos = p[new]
    doc = np.searchsorted(at, pos, side="right") - 1
    lo = np.maximum(at[doc], pos - (width - 1))
    hi = np.minimum(at[doc + 1], pos + length)
    clip = ((pos - lo) * (2 * length) + (hi - pos)).astype(np.uint64)
    context = mix(stretch_hash(sums, lo, hi) + mix(clip))
    return Runs(doc, pos - at[doc], starts[new] - at[doc], starts[until] - at[doc], hashes[pos], context)


def _long_runs(values: np.ndarray, length: int, gram: int) -> Runs:
    """Anchors of one long text, found piece by piece; a run that crosses pieces is joined again."""
    parts, margin = [], length
    for base in range(0, len(values) - length + 1, SPAN):
        lo, hi = max(0, base - margin), min(len(values), base + SPAN + 2 * length)
        r = _runs(values[lo:hi], np.array([0, hi - lo]), length, gram)
        inside = (r.last + lo >= base) & (r.first + lo < base + SPAN)
        r = r.take(np.flatnonzero(inside))
        r.pos, r.first, r.last = r.pos + lo, np.maximum(r.first + lo, base), np.minimum(r.last + lo, base + SPAN - 1)
        parts.append(r)
    out = Runs.join(parts)
    same = np.concatenate(([False], out.pos[1:] == out.pos[:-1]))
    head = np.flatnonzero(~same)
    merged = out.take(head)
    merged.last = out.last[np.concatenate((head[1:], [len(same)])) - 1]
    return merged


def anchor_runs(values: np.ndarray, at: np.ndarray, length: int, gram: int) -> Runs:
    """Anchors of all texts, in text and position order."""
    parts, sizes, i = [_none()], np.diff(at), 0
    while i < len(sizes):
        if sizes[i] > SPAN:
            r = _long_runs(values[at[i]:at[i + 1]], length, gram)
            r.doc = np.full(len(r.pos), i)
            i += 1
        else:
            j = i + 1
            while j < len(sizes) and at[j + 1] - at[i] <= SPAN:
                j += 1
            r = _runs(values[at[i]:at[j]], at[i:j + 1] - at[i], length, gram)
            r.doc = r.doc + i
            i = j
        parts.append(r)
    return Runs.join(parts)
