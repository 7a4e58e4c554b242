"""Quality rules: document counts and zstandard compression bands.

A whole document and each of its fixed chunks are compressed; a ratio
(raw / compressed bytes) above the upper limit marks repetitive text, one
below the lower limit incompressible text. Limits depend on the length
class, because short text compresses less than long text of one kind.

Hex and base64 compress as well as dense prose, but only as far as their
byte frequencies allow (ratio 8 / entropy), whatever the alphabet; prose of
any script repeats words and compresses further. So texts of
``CHUNK_BYTES`` or more, and chunks, must reach ``FREE_RATIO`` or beat that
ratio by ``MIN_GAIN``; shorter prose does not beat it yet, and only has the
bands. The rest after the last full chunk is judged as the last
``CHUNK_BYTES`` of the text.

Edge cases: a null or empty text has no words and fails the base rules;
every row is judged on its own, so repeated rows and repeated ids keep one
output row each; an empty table gives an empty result; columns other than
the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 4096
LEVEL = 3
# (smallest raw bytes, lowest ratio, highest ratio) by length class, natural order.
# Prose of any language lies well inside; the lowest limit catches random
# bytes, the highest one text made of a few repeated pieces.
WHOLE_BANDS = ((0, 0.0, 4.0), (512, 1.15, 5.0), (2048, 1.3, 7.0), (8192, 1.4, 9.0), (65536, 1.45, 14.0))
CHUNK_BAND = (1.2, 9.0)
# Lowest ratio * byte entropy / 8 from CHUNK_BYTES on. Measured at 4096 bytes: hex, base64, base85 and random bytes
# and characters at most 0.993 (1.000 at 65536), documents of sf0.1 at least 1.022, English files 1.116.
MIN_GAIN = 1.01
# Ratio that frees from it; hex in pairs, the highest measured, reaches 2.15 at 4096 bytes and 2.21 at 70000.
FREE_RATIO = 2.3
# A document goes when more than this share of its chunks is out of band.
MAX_BAD_CHUNK_SHARE = 0.25
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "whole_ratio double, n_chunks long, n_bad_chunks long, band_failed boolean")


def repeated_window_words(words: list[bytes], size: int = 3) -> int:
    """Words lying in a ``size``-word window that occurs at least twice in the list."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    code = seq[:n]
    for k in range(1, size):  # re-number after each step, so codes stay below n squared
        _, code = np.unique(code * len(ids) + seq[k:n + k], return_inverse=True)
    twice = np.bincount(code)[code] >= 2
    covered = np.zeros(len(words), bool)
    for k in range(size):
        covered[k:n + k] |= twice
    return int(covered.sum())


def whole_limits(n_bytes: int) -> tuple[float, float]:
    """Lowest and highest ratio allowed for a document of this length."""
    low, high = WHOLE_BANDS[0][1:]
    for start, lo, hi in WHOLE_BANDS:
        if n_bytes >= start:
            low, high = lo, hi
    return low, high


def byte_entropy(raw: bytes) -> float:
    """Bits a byte."""
    n = np.bincount(np.frombuffer(raw, np.uint8))
    share = n[n > 0] / len(raw)
    return float(-(share * np.log2(share)).sum())


def in_band(raw: bytes, ratio: float, low: float, high: float) -> bool:
    """True if the ratio is within the limits and, for long pieces, beats the byte frequencies."""
    encoded = CHUNK_BYTES <= len(raw) and ratio < FREE_RATIO and ratio * byte_entropy(raw) < 8 * MIN_GAIN
    return low <= ratio <= high and not encoded


def measure(text: str | None, compressor) -> tuple:
    """The counts and ratios of one text, in the order of the output columns."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # exactly the separators \x20 and \x09-\x0D
    word_chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    n_symbols = sum(text.count(c) for c in SYMBOLS)
    seen: set[bytes] = set()
    n_dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            n_dup += 1
        elif line.strip():
            seen.add(line)
    ratio = len(raw) / len(compressor.compress(raw)) if raw else 0.0
    low, high = whole_limits(len(raw))
    chunks = [raw[i:i + CHUNK_BYTES] for i in range(0, len(raw) - CHUNK_BYTES + 1, CHUNK_BYTES)]
    if chunks and len(raw) % CHUNK_BYTES:
        chunks.append(raw[-CHUNK_BYTES:])
    bad = sum(not in_band(c, CHUNK_BYTES / len(compressor.compress(c)), *CHUNK_BAND) for c in chunks)
    failed = bool(raw) and (not in_band(raw, ratio, low, high) or bad > MAX_BAD_CHUNK_SHARE * len(chunks))
    return (len(words), word_chars, n_symbols, n_dup, repeated_window_words(words), ratio, len(chunks), bad, failed)


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    compressor = zstandard.ZstdCompressor(level=LEVEL)
    types = [pa.int64()] * 5 + [pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
    names = [c.strip().split(" ")[0] for c in _SCHEMA.split(",")]
    for batch in batches:
        rows = [measure(t.as_py(), compressor) for t in batch.column(1)]
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(types)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=names)


def compression_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, ratios, ``base_failed`` and ``kept`` of every row of ``docs``."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base_failed = ((F.col("n_words") < MIN_WORDS)
                   | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return (src.mapInArrow(_measure_batches, _SCHEMA)
            .withColumn("base_failed", base_failed)
            .withColumn("kept", ~F.col("base_failed") & ~F.col("band_failed")))
