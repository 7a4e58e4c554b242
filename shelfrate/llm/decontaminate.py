"""Benchmark decontamination: Wu-Manber search for benchmark word windows.

Patterns are the windows of 10 consecutive words of each item (an item with
fewer words is one window). A block of two words ending at the scan position
looks up how far the scan may jump; when it may not jump, the patterns whose
last block it is are compared directly. Patterns shorter than a full window
are searched in groups of one length, so that each group keeps its largest
jump.

The pattern tables go to the tasks only up to ``MAX_PATTERN_BYTES``, which
is measured; a larger benchmark is searched in several passes over equal
parts of its items, each within the bound, and the parts are combined by a
union of hit positions. No document or item is shortened.

Edge cases: null and empty texts have no words, are not contaminated and no
item of theirs occurs; items with equal text are all reported; repeated
rows of documents are judged one by one; items with a null id are patterns
too (their words are hit) but have no id to list; empty tables give an empty
result or no hits; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 10
MAX_PATTERN_BYTES = 32 * 2**20
# A non-ASCII character is a word character, and so are its UTF-8 bytes.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

_SCHEMA = ("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
           "items array<string>, hit_words array<int>")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, runs of digits, a-z and non-ASCII characters."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class Patterns:
    """Shift and suffix tables of all patterns of one length."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.items: dict[tuple, set] = {}  # pattern words -> ids of the items that have it

    def add(self, words: tuple, item: str | None) -> None:
        self.items.setdefault(words, set()).add(item)

    def build(self) -> None:
        """shift: block -> safe jump; suffix: last block -> patterns."""
        self.shift: dict[tuple, int] = {}
        self.suffix: dict[tuple, list[tuple]] = {}
        for p in self.items:
            for end in range(self.block, self.length + 1):
                key = p[end - self.block:end]
                self.shift[key] = min(self.shift.get(key, self.length), self.length - end)
            self.suffix.setdefault(p[-self.block:], []).append(p)

    def search(self, words: list[bytes], hit: np.ndarray, found: set) -> None:
        """Mark the words of every occurrence in ``hit`` and add its items to ``found``."""
        m, b, n = self.length, self.block, len(words)
        default, shift = m - b + 1, self.shift
        at = m
        while at <= n:
            key = tuple(words[at - b:at])
            jump = shift.get(key, default)
            if jump:
                at += jump
                continue
            for p in self.suffix[key]:
                if words[at - m] == p[0] and tuple(words[at - m:at]) == p:
                    hit[at - m:at] = True
                    found.update(self.items[p])
            at += 1


def build_patterns(items: list[tuple[str | None, str | None]]) -> list[Patterns]:
    """Pattern groups of (item id, text) rows, one for each pattern length."""
    groups: dict[int, Patterns] = {}
    for item, text in items:
        words = words_of(text)
        size = min(WINDOW, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            groups.setdefault(size, Patterns(size)).add(tuple(words[i:i + size]), item)
    for g in groups.values():
        g.build()
    return list(groups.values())


def _digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


def _search_part(docs: DataFrame, items: list[tuple[str | None, str | None]]) -> DataFrame:
    """Hits of ``docs`` (doc_id, text, further columns to carry) against some items."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    names = [c.split(" ")[0] for c in _SCHEMA.split(", ")]
    types = [pa.int64()] * 4 + [pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = build_patterns(shared.value)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                hit, found = np.zeros(len(words), bool), set()
                for g in groups:
                    g.search(words, hit, found)
                ids = sorted(x for x in found if x is not None)
                n_hit = int(hit.sum())
                rows.append((doc, len(words), n_hit, len(ids), _digest(ids), n_hit > 0, ids,
                             np.flatnonzero(hit).astype(np.int32)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(types)
            extra = range(2, batch.num_columns)
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, t) for c, t in zip(cols, types, strict=True)], *[batch.column(i) for i in extra]],
                names=[*names, *[batch.schema.names[i] for i in extra]])

    carried = "".join(f", `{c}` {t}" for c, t in docs.dtypes[2:])
    return docs.mapInArrow(run, _SCHEMA + carried)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text",
                  carry: tuple[str, ...] = (), max_pattern_bytes: int = MAX_PATTERN_BYTES) -> DataFrame:
    """Hit counts, items and hit word positions of every row of ``docs``, with the columns named in ``carry``."""
    items = (benchmark.select(F.col(item_col).cast("string").alias("item"),
                              F.col(item_text_col).cast("string").alias("text"))
             .where(F.col("text").isNotNull()).distinct())
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.lit(64)), F.lit(0))).head()[0]
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                      *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    named = [F.col(f"_c{i}").alias(c) for i, c in enumerate(carry) if c != "doc_id"]
    own = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "hit_words"]
    n_parts = 1 + int(size) // max_pattern_bytes
    if n_parts == 1:
        return _search_part(src, [(r.item, r.text) for r in items.collect()]).select(*own, *named)
    src = src.withColumn("_row", F.monotonically_increasing_id())
    part = F.pmod(F.xxhash64("item", "text"), F.lit(2 * n_parts))
    pieces = [_search_part(src.select(F.col("_row").alias("doc_id"), "text"),
                           [(r.item, r.text) for r in items.where(part == k).collect()])
              for k in range(2 * n_parts)]
    union = pieces[0]
    for p in pieces[1:]:
        union = union.unionByName(p)
    merged = union.groupBy(F.col("doc_id").alias("_row")).agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_words")))).alias("hit_words"))
    return (src.drop("text").join(merged, "_row")
            .select("doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"),
                    F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                    (F.size("hit_words") > 0).alias("contaminated"), "items", "hit_words", *named))
