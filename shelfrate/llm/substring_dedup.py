"""Substring de-duplication by seed and extend.

Documents meet on winnowed anchors of ``GRAM`` words; all windows of
``LENGTH`` words around them are grouped by digest, which stands for extending
each match: the union of the repeated windows gives the maximal repeats over
the length threshold. The earliest copy (smaller id, or earlier start in one document)
stays, the words of later copies go.

Edge cases: a null text has no words; texts shorter than a window lose
nothing; repeated rows of an id and text are one document and get the same
result, one id with several texts is several documents in the order of their
hashes; a row with a null id loses nothing and is compared with nothing; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrate.llm.common import written
from shelfrate.llm.repeats import (COMPARE, MANY, WHOLE, Search, compare_windows, covered, find_seeds, listed,
                                   ordered_texts, window_starts, with_ids, with_lists)
from shelfrate.llm.tokens import hashed_words, utf8
from shelfrate.llm.winnow import anchor_runs

LENGTH, GRAM = 20, 6

_OUT = "doc long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>, kept string"


def spans_of(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of True as (start, end)."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _removed(search: Search, with_text: bool):
    """Final pass: the repeated windows of each document become removed words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [utf8(t) for t in b.column(1).to_pylist()]
            whole, starts = b.column(2).to_pylist(), b.column(3).to_pylist()
            values, at = hashed_words(texts)
            some = [i for i, w in enumerate(whole) if w]
            mask = np.zeros(len(values), bool)
            hit = [np.array(s, np.int64) + at[i] for i, s in enumerate(starts) if s]
            if some:
                r = anchor_runs(values, at, search.length, search.gram)
                pick = listed(r.doc, r.pos, whole)
                r.first, r.last = r.first + at[r.doc], r.last + at[r.doc]
                hit.append(window_starts(r, pick))
            if hit:
                begin = np.concatenate(hit)
                mask = covered(len(values), begin, begin + search.length)
            rows = []
            for i, raw in enumerate(texts):
                words, gone = raw.split(), mask[at[i]:at[i + 1]]
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words)
                rows.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(),
                             [{"start": s, "end": e} for s, e in spans_of(gone)],
                             kept.decode("utf-8", "surrogatepass") if with_text else None))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            types = [pa.int64(), pa.int64(), pa.string(), span, pa.string()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]],
                names=["doc", "n_words", "n_removed", "kept_sha256", "spans", "kept"])
    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id",
                   text_col: str = "text", with_text: bool = False) -> DataFrame:
    """id, n_words, n_removed, kept_sha256, removed word spans and (on request) the kept text of every row."""
    search = Search(hashed_words, length, gram, keep_first=True)
    src = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    src, numbers = ordered_texts(src)
    known = src.where(F.col("doc").isNotNull() & F.col("text").isNotNull())
    seeds = written(find_seeds(known, search), "seeds")
    later = written(compare_windows(with_lists(known, seeds, (COMPARE, MANY)), search), "later-windows")
    marks = seeds.where(F.col("state") == WHOLE).select("doc", F.col("pos").alias("whole"), F.lit(None).cast("long").alias("start"))
    lists = (marks.unionByName(later.select("doc", F.lit(None).cast("long").alias("whole"), "start"))
             .groupBy("doc").agg(F.collect_list("whole").alias("whole"), F.collect_list("start").alias("start")))
    out = (src.join(lists, "doc", "left").select("doc", "text", "whole", "start")
           .mapInArrow(_removed(search, with_text), _OUT))
    return with_ids(out, numbers, id_col)


