"""Vectorized word and window hashing for tasks (numpy only).

Hashes are 64-bit polynomial hashes over a random byte table, finished by a
bit mixer; prefix sums give the hash of any stretch in constant time.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240607)
BYTE_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
# Separators of words: \x20 and \x09-\x0D.
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
# Bytes of texts that are hashed at a time (a longer text alone).
CHUNK_BYTES = 1 << 19
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(kind: str, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; ``down`` has the inverse base."""
    have = _powers[kind]
    if len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        step = np.full(size, _BASE if kind == "up" else _INVERSE, np.uint64)
        step[0] = 1
        have = _powers[kind] = np.multiply.accumulate(step)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer over uint64 (wraps modulo 2**64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Running sums of values[i] * base**i, one longer than ``values``."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers("up", len(values)), out=out[1:])
    return out


def stretch_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair, independent of the place."""
    return mix((sums[ends] - sums[starts]) * powers("down", len(sums))[starts] + (ends - starts).astype(np.uint64))


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(data, np.uint8)
    word = ~_IS_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    hashes = stretch_hash(prefix_sums(BYTE_TABLE[raw]), starts, ends)
    begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))).astype(np.int64)
    return hashes, np.searchsorted(starts, begin)


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in one array, and the offset of each text in it (one more than texts)."""
    hashes, offsets, base, i = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0, 0
    while i < len(texts):
        j, size = i + 1, len(texts[i])
        while j < len(texts) and size + len(texts[j]) <= CHUNK_BYTES:
            size += len(texts[j])
            j += 1
        h, at = _hashed_words(texts[i:j])
        hashes.append(h)
        offsets.append(at[1:] + base)
        base += len(h)
        i = j
    return np.concatenate(hashes), np.concatenate(offsets)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of ``size``-word windows; a shorter sequence is one window, none is empty."""
    if not len(words):
        return words
    k = min(size, len(words))
    acc = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        acc = mix(acc + words[i:len(words) - k + 1 + i] * _BASE)
    return np.unique(acc)
