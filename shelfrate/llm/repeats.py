"""Repeated windows of a corpus: the search shared by the two exact de-duplication operators.

Seeds are winnowed anchors. Map tasks combine what they see: of one anchor
context (the anchor with all symbols that any of its windows can hold) only
the first place leaves the task, and an anchor with very many contexts
leaves it as one mark, so no group grows beyond a few rows for each task.
A context that stands at several places needs no comparison: all windows of
the anchor are equal there. Only places whose context differs from others
of the same anchor are compared window by window.

Places are (id, position); "earlier" is their order. Rows that repeat an id
and text are read as one document, one id with several texts as several in
the order of their hashes; rows with a null id are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrate.llm.common import written
from shelfrate.llm.tokens import prefix_sums, stretch_hash
from shelfrate.llm.winnow import Runs, anchor_runs
from shelfrate.plans.ordering import global_row_number

# Contexts of one anchor that a map task sends on one by one.
MAX_CONTEXTS = 64
# Contexts of one anchor that are compared in one task; beyond it the windows are spread over all tasks.
MAX_GROUP = 4096
# Rows that a task combines or decides at a time.
FLUSH = 1 << 18
# What is known of a place: all its windows are repeated (WHOLE), its windows must be compared (COMPARE),
# or both (BOTH: others are compared with it). MANY marks places of an anchor with very many contexts.
WHOLE, COMPARE, BOTH, MANY = 1, 2, 3, 4


@dataclass(frozen=True)
class Search:
    """What to look for.

    symbols: texts (bytes) -> (symbol values of all texts, offsets of the texts);
    length: symbols of a window; gram: symbols of an anchor;
    keep_first: whether the earliest of equal windows counts as not repeated.
    """
    symbols: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
    length: int
    gram: int
    keep_first: bool


_SEED = "gram long, context long, doc long, pos long, places long, state int"


def _seed_batch(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    n, step = len(rows["gram"]), 1 << 16
    for i in range(0, n, step):
        cut = {k: v[i:i + step] for k, v in rows.items()}
        yield pa.RecordBatch.from_arrays(
            [pa.array(cut["gram"].view(np.int64)), pa.array(cut["context"].view(np.int64)), pa.array(cut["doc"]),
             pa.array(cut["pos"]), pa.array(cut["places"]), pa.array(cut["state"].astype(np.int32))],
            names=["gram", "context", "doc", "pos", "places", "state"])


def _sizes(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def combine(gram: np.ndarray, context: np.ndarray, doc: np.ndarray, pos: np.ndarray, keep_first: bool) -> dict:
    """A map task's places, combined: state 0 rows go on to be grouped by gram, the others are decided."""
    order = np.lexsort((pos, doc, context))
    gram, context, doc, pos = gram[order], context[order], doc[order], pos[order]
    fresh = np.concatenate(([True], (context[1:] != context[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])))
    gram, context, doc, pos = gram[fresh], context[fresh], doc[fresh], pos[fresh]  # a repeated row is one place
    starts = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
    places = np.zeros(len(gram), np.int64)
    places[starts] = _sizes(starts, len(gram))
    state = np.where(places > 0, 0, WHOLE)
    heads = starts[np.argsort(gram[starts], kind="stable")]
    g = gram[heads]
    gs = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
    size = _sizes(gs, len(g))
    many = np.repeat(size > MAX_CONTEXTS, size)
    state[heads[many]] = MANY
    mark = heads[gs[size > MAX_CONTEXTS]]  # one mark for each such anchor, sent on as a place of no context
    rows = {"gram": gram, "context": context, "doc": doc, "pos": pos, "places": places, "state": state}
    if not keep_first:  # the first place of a context seen twice is repeated as well
        twice = starts[(places[starts] > 1) & (state[starts] == MANY)]
        rows = {k: np.concatenate((v, v[twice])) for k, v in rows.items()}
        rows["state"][len(gram):] = WHOLE
    marks = {"gram": gram[mark], "context": context[mark], "doc": doc[mark], "pos": pos[mark],
             "places": np.full(len(mark), -1, np.int64), "state": np.zeros(len(mark), np.int64)}
    return {k: np.concatenate((v, marks[k])) for k, v in rows.items()}


def _seeds(search: Search):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def flush():
            cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
            if len(cols[0]):
                yield from _seed_batch(combine(*cols, search.keep_first))

        for b in batches:
            values, at = search.symbols([t.encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()])
            r = anchor_runs(values, at, search.length, search.gram)
            parts.append((r.gram, r.context, b.column(0).to_numpy(zero_copy_only=False)[r.doc], r.pos))
            size += len(r.pos)
            if size >= FLUSH:
                yield from flush()
                parts, size = [], 0
        if parts:
            yield from flush()
    return run


def decide(gram, context, doc, pos, places, keep_first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram, doc, pos, state) of the places of complete anchor groups that are repeated or must be compared."""
    order = np.lexsort((-places, pos, doc, context, places >= 0, gram))
    cols = [x[order] for x in (gram, context, doc, pos, places)]
    again = np.concatenate(([False], np.logical_and.reduce([c[1:] == c[:-1] for c in cols[:4]])))
    again[1:] &= cols[4][:-1] >= 0  # a repeated row is one place
    gram, context, doc, pos, places = (c[~again] for c in cols)
    n = len(gram)
    new_gram = np.concatenate(([True], gram[1:] != gram[:-1]))
    group = np.cumsum(new_gram) - 1
    marked = np.zeros(group[-1] + 1, bool)
    marked[group[places < 0]] = True
    new_context = new_gram | np.concatenate(([True], (context[1:] != context[:-1]) | (places[:-1] < 0)))
    starts = np.flatnonzero(new_context)
    of_context = np.cumsum(new_context) - 1
    total = np.add.reduceat(np.maximum(places, 0), starts)[of_context]
    contexts = np.add.reduceat((new_context & (places >= 0)).astype(np.int64), np.flatnonzero(new_gram))[group]
    marked = marked[group] | (contexts > MAX_GROUP)
    several = marked | (contexts > 1)
    state = np.zeros(n, np.int64)
    if keep_first:
        state[~new_context] = WHOLE
        state[new_context & several] = np.where(marked, MANY, COMPARE)[new_context & several]
    else:
        state[total > 1] = WHOLE
        state[new_context & several] = np.where(marked, MANY, COMPARE)[new_context & several]
        both = new_context & several & ~marked & (total > 1)
        state[both] = BOTH
    state[places < 0] = 0
    more = np.zeros(0, np.int64)
    if not keep_first:  # compared with others, and repeated itself
        more = np.flatnonzero(new_context & marked & (places >= 0) & (total > 1))
    pick = np.concatenate((np.flatnonzero(state), more))
    state = np.concatenate((state[state > 0], np.full(len(more), WHOLE)))
    return gram[pick], doc[pick], pos[pick], state


def _decisions(search: Search):
    """Rows sorted by gram: decided ones pass, complete anchor groups are decided."""
    def out(gram, doc, pos, state):
        return pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(doc), pa.array(pos),
                                           pa.array(state.astype(np.int32))], names=["gram", "doc", "pos", "state"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for b in batches:
            cols = [b.column(i).to_numpy() for i in range(6)]
            done = np.flatnonzero(cols[5] > 0)
            if len(done):
                yield out(cols[0][done], cols[2][done], cols[3][done], cols[5][done])
                cols = [c[cols[5] == 0] for c in cols]
            if not len(cols[0]):
                continue
            parts.append(cols[:5])
            size += len(cols[0])
            if size >= FLUSH and cols[0][0] != cols[0][-1]:  # the last group may go on
                whole = [np.concatenate(c) for c in zip(*parts, strict=True)]
                cut = int(np.searchsorted(whole[0], whole[0][-1]))
                yield out(*decide(whole[0][:cut].view(np.uint64), *[c[:cut] for c in whole[1:]], search.keep_first))
                parts, size = [[c[cut:] for c in whole]], len(whole[0]) - cut
        if parts:
            whole = [np.concatenate(c) for c in zip(*parts, strict=True)]
            yield out(*decide(whole[0].view(np.uint64), *whole[1:], search.keep_first))
    return run


def find_seeds(docs: DataFrame, search: Search) -> DataFrame:
    """(gram, doc, pos, state) of every place that is repeated or must be compared; ``docs`` is (doc, text)."""
    seeds = docs.mapInArrow(_seeds(search), _SEED)
    # Decided rows need no grouping: they go to a partition by place.
    route = F.when(F.col("state") == 0, F.col("gram")).otherwise(F.xxhash64("doc", "pos"))
    return (seeds.withColumn("route", route).repartition("route").drop("route").sortWithinPartitions("gram")
            .mapInArrow(_decisions(search), "gram long, doc long, pos long, state int"))


def window_rows(search: Search, values: np.ndarray, at: np.ndarray, runs: Runs, ids: np.ndarray) -> list[np.ndarray]:
    """gram, window hash, id and start of every window of the runs."""
    size = runs.last - runs.first + 1
    start = np.repeat(runs.first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    doc = np.repeat(runs.doc, size)
    begin = start + at[doc]
    window = stretch_hash(prefix_sums(values), begin, begin + search.length)
    return [np.repeat(runs.gram, size).view(np.int64), window.view(np.int64), ids[doc].astype(np.int64), start]


def _windows(search: Search):
    """(gram, window, doc, start) of every window of the listed anchors of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, at = search.symbols([t.encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()])
            r = anchor_runs(values, at, search.length, search.gram)
            r = r.take(listed(r.doc, r.pos, b.column(2).to_pylist()))
            rows = window_rows(search, values, at, r, b.column(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["gram", "window", "doc", "start"])
    return run


def listed(doc: np.ndarray, pos: np.ndarray, lists: list[list[int] | None]) -> np.ndarray:
    """Indices of the (doc, pos) pairs whose position is in the document's list."""
    keep = np.zeros(len(doc), bool)
    for d, wanted in enumerate(lists):
        if wanted:
            lo, hi = np.searchsorted(doc, [d, d + 1])
            keep[lo:hi] = np.isin(pos[lo:hi], np.array(wanted, np.int64))
    return np.flatnonzero(keep)


def with_lists(docs: DataFrame, seeds: DataFrame, *states: tuple[int, ...]) -> DataFrame:
    """(doc, text, wanted0, ...): the documents with places in any group of states, and the places by group."""
    every = [s for group in states for s in group]
    lists = seeds.where(F.col("state").isin(*every)).groupBy("doc").agg(  # bounded by the length of the document
        *[F.collect_list(F.when(F.col("state").isin(*g), F.col("pos"))).alias(f"wanted{i}") for i, g in enumerate(states)])
    return docs.join(lists, "doc").select("doc", "text", *[f"wanted{i}" for i in range(len(states))])


_WINDOW_ROWS = "gram long, window long, doc long, start long"


def _marks(keep_first: bool):
    """The repeated rows of one sorted partition; its first and last row also come back as edges."""
    names = ["gram", "window", "doc", "start", "edge"]

    def out(cols, pick, edge):
        rows = [c[pick] for c in cols]
        return pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array(np.full(len(rows[0]), edge))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(i).to_numpy() for i in range(4)]
            if tail is None:
                yield out(cols, slice(0, 1), True)
            else:
                cols = [np.concatenate((t, c)) for t, c in zip(tail, cols, strict=True)]
            gram, window, doc, start = cols
            # a row that repeats a place is no other place
            again = ((gram[1:] == gram[:-1]) & (window[1:] == window[:-1])
                     & ((doc[1:] != doc[:-1]) | (start[1:] != start[:-1])))
            hit = np.append(False, again)
            if not keep_first:
                hit[:-1] |= again
            yield out(cols, hit, False)
            tail = [c[-1:] for c in cols]
        if tail is not None:
            yield out(tail, slice(0, 1), True)
    return run


def repeated_windows(windows: DataFrame, search: Search) -> DataFrame:
    """(doc, start) of the repeated ones of ``windows`` (gram, window, doc, start).

    All windows are sorted over all partitions, equal ones by place, so a row
    is repeated if the row before it is equal (or behind it, where the first
    one counts as well). A window found very often spreads like any others,
    and nothing is joined. Rows at the ends of partitions are compared again
    among themselves.
    """
    order = ["gram", "window", "doc", "start"]
    schema = f"{_WINDOW_ROWS}, edge boolean"
    marked = written(windows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
                     .mapInArrow(_marks(search.keep_first), schema), "repeated")
    ends = (marked.where("edge").select(*order).coalesce(1).sortWithinPartitions(*order)
            .mapInArrow(_marks(search.keep_first), schema))
    return marked.unionByName(ends).where(~F.col("edge")).select("doc", "start")


def ordered_texts(src: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``src`` (doc, text) with a number for each text in place of ids that stand for several texts.

    Places are known by ``doc``, so an id with unrelated texts would get the
    removals of each on all of them. If there is any such id, all texts are
    numbered in the order of id and text hash, and (doc, id) tells the ids.
    """
    texts = src.where(F.col("doc").isNotNull()).select("doc", F.xxhash64("text").alias("mark")).distinct()
    texts = written(texts, "texts")
    if texts.groupBy("doc").count().where(F.col("count") > 1).isEmpty():
        return src, None
    numbers = written(global_row_number(texts, [F.col("doc"), F.col("mark")], out="number"), "numbers")
    joined = src.withColumn("mark", F.xxhash64("text")).join(numbers, ["doc", "mark"], "left")
    return joined.select(F.col("number").alias("doc"), "text"), numbers.select(
        F.col("number").alias("doc"), F.col("doc").alias("id"))


def with_ids(out: DataFrame, numbers: DataFrame | None, id_col: str) -> DataFrame:
    """``out`` with the ids instead of the numbers of ``ordered_texts``."""
    if numbers is None:
        return out.withColumnRenamed("doc", id_col)
    named = out.join(numbers, "doc", "left")
    return named.select(F.col("id").alias(id_col), *[c for c in out.columns if c != "doc"])


def compare_windows(listed_docs: DataFrame, search: Search) -> DataFrame:
    """(doc, start) of the repeated windows among all windows of the listed places."""
    return repeated_windows(listed_docs.mapInArrow(_windows(search), _WINDOW_ROWS), search)


def window_starts(runs: Runs, wanted: np.ndarray) -> np.ndarray:
    """All window starts of the runs at the given indices."""
    first, size = runs.first[wanted], runs.last[wanted] - runs.first[wanted] + 1
    return np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of the symbols in any [start, end)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0
