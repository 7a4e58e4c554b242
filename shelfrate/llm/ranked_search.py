"""Ranked lexical search by presence masks.

Every item of a query table ranks all documents. One pass over the texts
writes each document's term count and its occurrences of query terms; the
corpus statistics (documents, terms, documents of each term) come from that
table. Then tasks take blocks of documents: for one item, the bitmaps of its
terms over the block are turned into one mask for each document, equal masks
form a group, and no document of a group can score more than the sum of the
block's largest contributions of the mask's terms. Groups are scored in
descending order of that bound until it falls below the score of the last
place, which is safe. A task keeps the best ``top`` of each item over all of
its blocks, and a ranking over these rows gives the result.

The query terms of an item list go to the tasks only up to
``MAX_QUERY_BYTES``, which is measured; a longer list is searched in several
passes over parts of the items. Documents are never cut or skipped.

Edge cases: null and empty texts have no terms and are found by nothing; an
item without terms, or only with terms of weight 0, finds nothing; repeated
document rows are ranked one by one; an item row that repeats id and text
counts once, one that repeats only the id is an item of its own; equal scores
are ordered by id, null ids last; empty tables give an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from shelfrate.llm.common import written
from shelfrate.llm.packed_terms import (ASCII_DIGITS, ASCII_LETTERS, TermIndex, byte_class, radix_order, run_starts,
                                        stretches, text_bytes)

TOP = 50
MAX_QUERY_BYTES = 16 * 2**20
# Bytes of texts that a task counts at a time (a longer text alone).
CHUNK_BYTES = 4 << 20
# Documents, and occurring (document, term) pairs, of a block (one document may have more pairs).
BLOCK_DOCS, BLOCK_PAIRS = 1 << 16, 1 << 21
# Bits of the bitmaps of one item over a range of documents.
MAX_BITS = 1 << 25
# Documents that the first round of an item scores; each further round takes twice as many.
FIRST_ROUND = 256
_MEMBERS = byte_class(ASCII_DIGITS, ASCII_LETTERS)
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")

_POSTINGS = "doc_id long, n long, terms array<int>, counts array<int>"


def terms_of(text: str | None) -> list[bytes]:
    """Distinct terms of a text, in order."""
    return list(dict.fromkeys(_TERM.findall((text or "").encode("utf-8", "surrogatepass").lower())))


def _postings(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TermIndex(shared.value)
        held, size = [], 0

        def flush():
            rows = pa.Table.from_batches(held).combine_chunks()
            raw, at = text_bytes(rows.column(1).combine_chunks())
            starts, ends, text = stretches(raw, at, _MEMBERS)
            n = np.bincount(text, minlength=rows.num_rows)
            term = index.find(raw, starts, ends)
            hit = term >= 0
            keys = (text[hit].astype(np.uint64) << np.uint64(32)) | term[hit].astype(np.uint64)
            pairs, count = np.unique(keys, return_counts=True)
            some = np.flatnonzero(n)
            offsets = np.searchsorted(pairs >> np.uint64(32), np.append(some, rows.num_rows).astype(np.uint64))
            offsets = pa.array(offsets.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).combine_chunks().take(pa.array(some)), pa.array(n[some].astype(np.int64)),
                 pa.ListArray.from_arrays(offsets, pa.array((pairs & np.uint64(0xFFFFFFFF)).astype(np.int32))),
                 pa.ListArray.from_arrays(offsets, pa.array(count.astype(np.int32)))],
                names=["doc_id", "n", "terms", "counts"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.column(1).nbytes
                if size >= CHUNK_BYTES:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()
    return run


class Best:
    """The best ``top`` (score, id) rows of one item."""

    def __init__(self, top: int):
        self.top = top
        self.score, self.id, self.unnamed = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        score, ids, unnamed = (np.concatenate(x) for x in
                               ((self.score, score), (self.id, ids), (self.unnamed, unnamed)))
        order = np.lexsort((ids, unnamed, -score))[:self.top]
        order = order[score[order] > 0]
        self.score, self.id, self.unnamed = score[order], ids[order], unnamed[order]

    @property
    def floor(self) -> int:
        """What a document must reach to get in, by its score alone."""
        return int(self.score[-1]) if len(self.score) == self.top else 1


class Block:
    """Contributions of all query terms in some documents, ordered by term."""

    def __init__(self, ids: pa.Array, n: np.ndarray, at: np.ndarray, term: np.ndarray, count: np.ndarray, stats: dict):
        self.size = len(n)
        self.unnamed = np.array(ids.is_null())
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        m = 50 + _share(50 * n, stats["docs"], stats["terms"])
        doc = np.repeat(np.arange(len(n)), np.diff(at))
        order = np.argsort(term, kind="stable")
        self.term, self.doc = term[order], doc[order]
        tf = count[order].astype(np.int64)
        self.part = stats["weight"][self.term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[self.doc]))

    def rank(self, terms: np.ndarray, best: Best, first_round: int = FIRST_ROUND) -> int:
        """Add the block's documents to the best of an item with these terms; the number of scored documents."""
        low, high = np.searchsorted(self.term, terms), np.searchsorted(self.term, terms, side="right")
        found = np.flatnonzero(high > low)
        docs = [self.doc[low[i]:high[i]] for i in found]
        parts = [self.part[low[i]:high[i]] for i in found]
        scored, step = 0, max(1024, MAX_BITS // max(1, len(docs)))
        for base in range(0, self.size if docs else 0, step):  # bitmaps of bounded size, also for very long items
            cut = [np.searchsorted(d, (base, base + step)) for d in docs]
            some = [i for i, (x, y) in enumerate(cut) if y > x]
            if some:
                scored += self._rank_range(base, min(step, self.size - base), [docs[i][slice(*cut[i])] for i in some],
                                           [parts[i][slice(*cut[i])] for i in some], best, first_round)
        return scored

    def _rank_range(self, base: int, n: int, docs: list, parts: list, best: Best, room: int) -> int:
        bits = np.zeros((len(docs), n), bool)
        for row, d in zip(bits, docs, strict=True):
            row[d - base] = True
        touched = np.flatnonzero(bits.any(axis=0))
        masks = mask_words(bits[:, touched])
        order = radix_order(*masks)
        starts = run_starts(*[w[order] for w in masks])
        most = np.array([p.max() for p in parts], np.int64)
        bound = most @ bits[:, touched[order[starts]]].astype(np.int64)
        size = np.diff(np.append(starts, len(order)))
        groups = np.argsort(-bound, kind="stable")
        at = scored = 0
        while at < len(groups) and bound[groups[at]] >= best.floor:
            until = at + 1 + int(np.searchsorted(np.cumsum(size[groups[at:]]), room))
            chosen = groups[at:until]
            chosen = chosen[bound[chosen] >= best.floor]
            inner = np.arange(size[chosen].sum()) - np.repeat(np.cumsum(size[chosen]) - size[chosen], size[chosen])
            d = np.sort(touched[order[np.repeat(starts[chosen], size[chosen]) + inner]]) + base
            best.add(self._scores(d, docs, parts), self.ids[d], self.unnamed[d])
            at, scored, room = until, scored + len(d), 2 * room
        return scored

    @staticmethod
    def _scores(wanted: np.ndarray, docs: list[np.ndarray], parts: list[np.ndarray]) -> np.ndarray:
        score = np.zeros(len(wanted), np.int64)
        for d, p in zip(docs, parts, strict=True):
            at = np.minimum(np.searchsorted(d, wanted), len(d) - 1)
            score += np.where(d[at] == wanted, p[at], 0)
        return score


def mask_words(bits: np.ndarray) -> list[np.ndarray]:
    """Columns of a bit table (one row for each term) as masks of one uint64 for each 64 terms."""
    table = np.packbits(bits, axis=0)
    padded = np.zeros((-(-len(table) // 8) * 8, bits.shape[1]), np.uint8)
    padded[:len(table)] = table
    return [np.ascontiguousarray(padded[i:i + 8].T).view(np.uint64).ravel() for i in range(0, len(padded), 8)]


def _share(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """(n * docs) div terms, also where the product exceeds 64 bits."""
    if len(n) and int(n.max()) * docs >= 2**63:
        return np.array([int(x) * docs // terms for x in n], np.int64)
    return n * docs // terms


def _ranked(shared, top: int, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, stats = shared.value
        best = [Best(top) for _ in items]
        held: list[pa.RecordBatch] = []
        docs = pairs = 0

        def work():
            t = pa.Table.from_batches(held).combine_chunks()
            terms, counts = (t.column(c).combine_chunks() for c in ("terms", "counts"))
            at = np.concatenate(([0], np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
            block = Block(t.column("doc_id").combine_chunks(), t.column("n").to_numpy(), at,
                          terms.flatten().to_numpy(), counts.flatten().to_numpy(), stats)
            for (_, wanted), b in zip(items, best, strict=True):
                block.rank(wanted, b)

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            docs += b.num_rows
            pairs += len(b.column(2).flatten())
            if docs >= BLOCK_DOCS or pairs >= BLOCK_PAIRS:
                work()
                held.clear()
                docs = pairs = 0
        if held:
            work()
        for number, ((item, _), b) in enumerate(zip(items, best, strict=True)):
            if len(b.score):
                k = len(b.score)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * k, pa.int32()), pa.array([item] * k, item_type),
                     pa.array(b.id, mask=b.unnamed), pa.array(b.score)], names=["number", "item_id", "doc_id", "score"])
    return run


def _search_part(docs: DataFrame, items: list[tuple], item_dtype, top: int) -> DataFrame:
    """Best documents of some items, ranked; ``docs`` is (doc_id, text)."""
    spark = docs.sparkSession
    words = [terms_of(text) for _, text in items]
    vocabulary = list(dict.fromkeys(t for w in words for t in w))
    number = {t: i for i, t in enumerate(vocabulary)}
    postings = written(docs.mapInArrow(_postings(spark.sparkContext.broadcast(vocabulary)), _POSTINGS), "postings")
    n_docs, n_terms = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    # One row for each query term at most: bounded by MAX_QUERY_BYTES.
    holders = postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    weight = np.zeros(len(vocabulary), np.int64)
    for r in holders:
        weight[r.term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["count"] + 1)))
    wanted = [(item, np.array(sorted(number[t] for t in w if weight[number[t]] > 0), np.int64))
              for (item, _), w in zip(items, words, strict=True)]
    shared = spark.sparkContext.broadcast((wanted, {"docs": n_docs, "terms": n_terms, "weight": weight}))
    best = postings.mapInArrow(_ranked(shared, top, to_arrow_type(item_dtype)),
                               f"number int, item_id {item_dtype.simpleString()}, doc_id long, score long")
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("item_id", "rank", "doc_id", "score"))


def ranked_search(docs: DataFrame, queries: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text",
                  max_query_bytes: int = MAX_QUERY_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of every row of ``queries``."""
    items = (queries.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text"))
             .where(F.col("text").isNotNull()).distinct())
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.lit(64)), F.lit(0))).head()[0]
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dtype = items.schema["item"].dataType
    n_parts = 1 if size <= max_query_bytes else 2 * (1 + int(size) // max_query_bytes)
    part = F.pmod(F.xxhash64("text"), F.lit(n_parts))
    out = None
    for k in range(n_parts):
        found = _search_part(src, [tuple(r) for r in items.where(part == k).collect()], dtype, top)
        out = found if out is None else out.unionByName(found)
    return out


def oracle_sql() -> str:
    """The same rows in DuckDB SQL: every document with a term of the item is scored."""
    terms = ("regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS ts FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS docs, sum(len(ts))::BIGINT AS terms FROM d WHERE len(ts) > 0),
q AS (SELECT row_number() OVER () AS i, item_id, unnest(list_distinct({terms})) AS term
      FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
o AS (SELECT r, unnest(ts) AS term FROM d),
t AS (SELECT r, term, count(*) AS tf FROM o WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM t, s GROUP BY term, docs),
m AS (SELECT r, doc_id, 100 - 50 + (50 * len(ts) * docs) // terms AS m FROM d, s),
scored AS (
  SELECT q.i, q.item_id, m.doc_id, sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 20 * m.m)))::BIGINT AS score
  FROM q JOIN t ON t.term = q.term JOIN w ON w.term = q.term JOIN m ON m.r = t.r
  GROUP BY q.i, q.item_id, m.r, m.doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
