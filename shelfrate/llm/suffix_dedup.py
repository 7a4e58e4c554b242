"""Suffix-array de-duplication of bytes by longest-previous-factor tests.

Every text is its UTF-8 bytes. Winnowed anchors of ``GRAM`` bytes bring the
places together that can share a string of ``LENGTH`` bytes; the fragments
around the places of one anchor meet in one task, which puts their suffixes
in order, takes the common prefixes of neighbours and, through the previous
and next smaller positions, the longest previous (or next) factor of each
start; a start whose factor reaches the length begins a repeated string.
Of an anchor with very many contexts the windows are sorted over all tasks by
digest and position: there the row before an equal one is its previous
smaller position.

By default later copies go and the earliest one stays; with
``keep_first=False`` every copy goes.

Edge cases: null and empty texts have no bytes; texts shorter than the
length lose nothing; overlapping repeats within a text count; repeated rows
of an id and text are one document and get the same result, one id with
several texts is several documents in the order of their hashes; a row with a null id
loses nothing and is compared with nothing; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrate.llm.common import written
from shelfrate.llm.repeats import (BOTH, COMPARE, MANY, WHOLE, Search, covered, find_seeds, listed, ordered_texts,
                                   repeated_windows, window_rows, with_ids, with_lists)
from shelfrate.llm.substring_dedup import spans_of
from shelfrate.llm.suffix_array import previous_factors
from shelfrate.llm.tokens import BYTE_TABLE, utf8
from shelfrate.llm.winnow import anchor_runs

LENGTH, GRAM = 200, 64
# Bytes of fragments whose suffixes a task sorts at a time, if its anchor groups allow.
SORT_BYTES = 1 << 20

_OUT = ("doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
        "spans array<struct<start:int,end:int>>, kept binary")


def byte_symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbol values of all bytes, and the offset of each text."""
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    return BYTE_TABLE[np.frombuffer(b"".join(texts), np.uint8)], at


def _fragments(search: Search):
    """(gram, window, doc, start, bytes): the bytes of all windows of each place to be sorted, the digests of the others."""
    names = ["gram", "window", "doc", "start", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [utf8(t) for t in b.column(1).to_pylist()]
            values, at = byte_symbols(texts)
            runs = anchor_runs(values, at, search.length, search.gram)
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            r = runs.take(listed(runs.doc, runs.pos, b.column(2).to_pylist()))
            if len(r.pos):
                cut = [texts[d][s:e + search.length] for d, s, e in
                       zip(r.doc.tolist(), r.first.tolist(), r.last.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r.gram.view(np.int64)), pa.nulls(len(cut), pa.int64()), pa.array(ids[r.doc]),
                     pa.array(r.first), pa.array(cut, pa.binary())], names=names)
            r = runs.take(listed(runs.doc, runs.pos, b.column(3).to_pylist()))
            if len(r.pos):
                rows = [pa.array(x) for x in window_rows(search, values, at, r, ids)]
                yield pa.RecordBatch.from_arrays([*rows, pa.nulls(len(rows[0]), pa.binary())], names=names)
    return run


def _sorted_part(doc: np.ndarray, start: np.ndarray, pieces: list[bytes], search: Search):
    """(doc, first, last) runs of repeated window starts among the fragments of complete anchor groups."""
    order = np.lexsort((start, doc))
    fresh = np.concatenate(([True], (doc[order][1:] != doc[order][:-1]) | (start[order][1:] != start[order][:-1])))
    order = order[fresh]  # a repeated row is one place
    doc, start, pieces = doc[order], start[order], [pieces[i] for i in order]
    size = np.array([len(p) for p in pieces], np.int64)
    begin = np.cumsum(size) - size
    count = size - search.length + 1
    which = np.repeat(np.arange(len(pieces)), count)
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    previous, following = previous_factors(np.frombuffer(b"".join(pieces), np.uint8), begin[which] + inner, search.length,
                                           later=not search.keep_first)
    hit = (previous if search.keep_first else np.maximum(previous, following)) >= search.length
    same = which[1:] == which[:-1]
    first = np.flatnonzero(hit & ~np.concatenate(([False], hit[:-1] & same)))
    last = np.flatnonzero(hit & ~np.concatenate((hit[1:] & same, [False])))
    return doc[which[first]], start[which[first]] + inner[first], start[which[last]] + inner[last]


def _sort_suffixes(search: Search):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            doc, start, pieces = zip(*rows, strict=True)
            cols = _sorted_part(np.array(doc, np.int64), np.array(start, np.int64), list(pieces), search)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc", "first", "last"])

        rows, size, gram = [], 0, None
        for b in batches:
            for g, *row in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                if g != gram and size >= SORT_BYTES:  # an anchor group is never cut
                    yield out(rows)
                    rows, size = [], 0
                gram = g
                rows.append(row)
                size += len(row[2])
        if rows:
            yield out(rows)
    return run


def _removed(search: Search, with_bytes: bool):
    """Final pass: places and starts of repeated windows become removed bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary()]
        for b in batches:
            texts = [utf8(t) for t in b.column(1).to_pylist()]
            whole, first, last = (b.column(i).to_pylist() for i in (2, 3, 4))
            n = sum(map(len, texts))
            mask = np.zeros(n, bool)
            if any(whole) or any(first):
                values, at = byte_symbols(texts)
                begin = [np.array(f, np.int64) + at[i] for i, f in enumerate(first) if f]
                end = [np.array(x, np.int64) + at[i] for i, x in enumerate(last) if x]
                if any(whole):
                    r = anchor_runs(values, at, search.length, search.gram)
                    pick = listed(r.doc, r.pos, whole)
                    begin.append((r.first + at[r.doc])[pick])
                    end.append((r.last + at[r.doc])[pick])
                mask = covered(n, np.concatenate(begin), np.concatenate(end) + search.length)
            rows, at = [], 0
            for raw in texts:
                gone = mask[at:at + len(raw)]
                at += len(raw)
                spans = spans_of(gone)
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if spans else raw
                rows.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(),
                             [{"start": s, "end": e} for s, e in spans], kept if with_bytes else None))
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]],
                names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])
    return run


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = True,
                          id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, removed byte spans and (on request) the kept bytes of every row."""
    search = Search(byte_symbols, length, gram, keep_first)
    src = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    src, numbers = ordered_texts(src)
    known = src.where(F.col("doc").isNotNull() & F.col("text").isNotNull())
    seeds = written(find_seeds(known, search), "seeds")
    places = written(with_lists(known, seeds, (COMPARE, BOTH), (MANY,)).mapInArrow(
        _fragments(search), "gram long, window long, doc long, start long, bytes binary"), "fragments")
    sorted_runs = (places.where(F.col("window").isNull()).select("gram", "doc", "start", "bytes")
                   .repartition("gram").sortWithinPartitions("gram")
                   .mapInArrow(_sort_suffixes(search), "doc long, first long, last long"))
    many = repeated_windows(places.where(F.col("window").isNotNull()).select("gram", "window", "doc", "start"), search)
    found = sorted_runs.unionByName(many.select("doc", F.col("start").alias("first"), F.col("start").alias("last")))
    nothing = F.lit(None).cast("long")
    marks = seeds.where(F.col("state").isin(WHOLE, BOTH)).select(
        "doc", F.col("pos").alias("whole"), nothing.alias("first"), nothing.alias("last"))
    lists = (marks.unionByName(found.select("doc", nothing.alias("whole"), "first", "last")).groupBy("doc")
             .agg(F.collect_list("whole").alias("whole"),
                  F.collect_list(F.when(F.col("first").isNotNull(), F.struct("first", "last"))).alias("runs"))
             .select("doc", "whole", F.col("runs.first").alias("first"), F.col("runs.last").alias("last")))
    out = (src.join(lists, "doc", "left").select("doc", "text", "whole", "first", "last")
           .mapInArrow(_removed(search, with_bytes), _OUT))
    return with_ids(out, numbers, id_col)
