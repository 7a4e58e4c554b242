"""Counting terms of byte texts with numpy: length-bucketed packing, radix sort, run counts.

A term of up to 8 bytes is one uint64 (big-endian, padded with zero bytes,
which no term contains), one of up to 16 bytes is two; both kinds are radix
sorted by 16-bit digits. Longer terms go to one bucket for each power of two
of their length and are sorted there as byte strings.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

ASCII_LETTERS = np.r_[65:91, 97:123]
ASCII_DIGITS = np.r_[48:58]


def byte_class(*ascii_ranges: np.ndarray) -> np.ndarray:
    """Mask over byte values: the given ASCII characters and every byte of a non-ASCII character."""
    mask = np.zeros(256, bool)
    mask[128:] = True
    for r in ascii_ranges:
        mask[r] = True
    return mask


def lower_table() -> np.ndarray:
    """Byte map that lower-cases A-Z only."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


_LOWER = lower_table()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end (A-Z lower-cased) and the offset of each; a null text is empty."""
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return _LOWER[raw], at - at[0] if len(at) else np.zeros(1, np.int64)


def stretches(raw: np.ndarray, at: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of member bytes; a run never crosses texts."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = members[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[at] = True  # a text begins here
    before = np.empty(len(raw), bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(raw), bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(at, starts, side="right") - 1


def packed(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, words: int) -> list[np.ndarray]:
    """The terms as ``words`` uint64 each."""
    out = []
    padded = np.concatenate((raw, np.zeros(8 * words, np.uint8)))
    for w in range(words):
        value = np.zeros(len(starts), np.uint64)
        for j in range(8 * w, 8 * w + 8):
            byte = np.where(j < sizes, padded[starts + j], 0)
            value = (value << np.uint64(8)) | byte.astype(np.uint64)
        out.append(value)
    return out


def radix_order(*keys: np.ndarray) -> np.ndarray:
    """Stable order by uint64 keys, the first one leading: least significant 16-bit digit first."""
    order = np.arange(len(keys[0]))
    for key in reversed(keys):
        top = int(key.max()) if len(key) else 0
        for shift in range(0, max(1, top.bit_length()), 16):
            digit = (key >> np.uint64(shift)).astype(np.uint16)[order]
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit, kind="stable")]  # numpy sorts 16-bit keys by radix
    return order


def run_starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """First index of each run of equal keys."""
    n = len(sorted_keys[0])
    fresh = np.ones(n, bool)
    if n:
        fresh[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return np.flatnonzero(fresh)


@dataclass
class Counted:
    """Distinct (group, term) rows: the terms as Arrow strings, occurrences and texts."""
    group: np.ndarray
    term: pa.Array
    count: np.ndarray
    texts: np.ndarray


def _strings(words: list[np.ndarray]) -> pa.Array:
    """Packed words as strings: their bytes without the padding."""
    table = np.stack(words, axis=1).astype(">u8").view(np.uint8).reshape(len(words[0]), 8 * len(words))
    data = table[table != 0]
    return _string_array((table != 0).sum(1), data.tobytes())


def _string_array(sizes: np.ndarray, data: bytes) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def _long_bucket(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Terms of one bucket as fixed-width byte strings."""
    grid = np.zeros((len(starts), width), np.uint8)
    index = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    grid[np.repeat(np.arange(len(starts)), sizes), index] = raw[np.repeat(starts, sizes) + index]
    return grid.view(f"S{width}").ravel()


def _counted(group: np.ndarray, text: np.ndarray, order: np.ndarray, keys: list[np.ndarray], strings) -> Counted:
    """Runs of (group, keys) in an order that keeps equal terms in text order."""
    g, t, k = group[order], text[order], [x[order] for x in keys]
    at = run_starts(g, *k)
    fresh = np.ones(len(t), np.int64)
    fresh[1:] = t[1:] != t[:-1]
    fresh[at] = 1  # the first occurrence in a run counts its text
    return Counted(g[at], strings([x[at] for x in k]), np.diff(np.append(at, len(t))),
                   np.add.reduceat(fresh, at) if len(at) else at)


def count_terms(raw: np.ndarray, at: np.ndarray, text_group: np.ndarray, members: np.ndarray) -> list[Counted]:
    """Occurrences and texts of every term in each group of texts, one part for each length bucket."""
    starts, ends, text = stretches(raw, at, members)
    sizes = ends - starts
    out = []
    for words in (1, 2):
        pick = np.flatnonzero((sizes > 8 * (words - 1)) & (sizes <= 8 * words))
        if len(pick):
            keys = packed(raw, starts[pick], sizes[pick], words)
            group = text_group[text[pick]]
            out.append(_counted(group, text[pick], radix_order(group.astype(np.uint64), *keys), keys, _strings))
    bucket = np.where(sizes > 16, np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64), 0)
    for b in np.unique(bucket[bucket > 0]).tolist():
        pick = np.flatnonzero(bucket == b)
        term = _long_bucket(raw, starts[pick], sizes[pick], 1 << b)
        group = text_group[text[pick]]
        out.append(_counted(group, text[pick], np.lexsort((term, group)), [term],
                            lambda k: _string_array(np.char.str_len(k[0]), b"".join(k[0].tolist()))))
    return out


class TermIndex:
    """Numbers of a bounded list of terms, looked up by their packed bytes."""

    def __init__(self, terms: list[bytes]):
        self.buckets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_width: dict[int, list[int]] = {}
        for i, t in enumerate(terms):
            by_width.setdefault(self._width(len(t)), []).append(i)
        for width, numbers in by_width.items():
            chosen = [terms[i] for i in numbers]
            raw = np.frombuffer(b"".join(chosen), np.uint8)
            sizes = np.array([len(t) for t in chosen], np.int64)
            keys = self._keys(raw, np.cumsum(sizes) - sizes, sizes, width)
            order = np.argsort(keys, kind="stable")
            self.buckets[width] = keys[order], np.array(numbers, np.int64)[order]

    @staticmethod
    def _width(size: int) -> int:
        return max(8, 1 << (size - 1).bit_length())

    @staticmethod
    def _keys(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
        return packed(raw, starts, sizes, 1)[0] if width == 8 else _long_bucket(raw, starts, sizes, width)

    def find(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of each term, -1 for one that is not in the list."""
        sizes = ends - starts
        out = np.full(len(starts), -1, np.int64)
        for width, (keys, numbers) in self.buckets.items():
            pick = np.flatnonzero((sizes <= width) & (sizes > (0 if width == 8 else width // 2)))
            for i in range(0, len(pick), max(1, (1 << 24) // width)):  # bounded grids
                part = pick[i:i + max(1, (1 << 24) // width)]
                wanted = self._keys(raw, starts[part], sizes[part], width)
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                out[part] = np.where(keys[at] == wanted, numbers[at], -1)
        return out
