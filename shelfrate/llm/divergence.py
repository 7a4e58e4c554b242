"""Source divergence audit: how far the sources of a language are apart in their terms.

Tasks count the terms of their texts by length-bucketed packing
(``packed_terms``) and hand on one row for each (language, source, term) and
chunk of texts; Spark adds these up. Each language keeps the terms found in
at least ``MIN_DOCS`` of its documents. Every group (language and source)
and every language gives each kept term the smoothed share
p = 1 + floor(SCALE * (count + 1) / (N + V)), and the distance of two
shares is floor((p - q)**2 / q): pairs of sources add it up over all kept
terms, single terms are held against the language's share.

A pair's sum runs over all kept terms, also those that neither source has.
It is split into what depends on one source alone and a correction for the
terms that both have; only the latter looks at two sources, in numpy, over
the rows of a term, and leaves the task as sums for each pair of sources.
All arithmetic is in integers.

Edge cases: null text, lang and source are read as ''; a group without terms
or a language without kept terms still appears (V = 0: every sum is 0);
repeated rows and ids count as documents of their own; equal values are
ranked by the item's UTF-8 bytes; very long texts and terms are counted whole;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfrate.llm.common import written
from shelfrate.llm.packed_terms import ASCII_LETTERS, byte_class, count_terms, run_starts, text_bytes

MIN_DOCS, SCALE, TOP_TERMS = 3, 1_000_000_000, 200
# Bytes of texts that a task counts at a time (a longer text alone).
CHUNK_BYTES = 8 << 20
# Values that a task's pair sums hold before they are handed on.
MAX_SUMS = 1 << 20
_MEMBERS = byte_class(ASCII_LETTERS)

_COUNTS = "lang string, source string, term string, n long, docs long"


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) for each chunk of texts."""
    held, size = [], 0

    def flush():
        rows = pa.Table.from_batches(held).combine_chunks()
        raw, at = text_bytes(rows.column(2).combine_chunks() if rows.num_rows else pa.array([], pa.string()))
        pairs = pa.table({"lang": rows.column(0), "source": rows.column(1), "row": np.arange(rows.num_rows)})
        firsts = pairs.group_by(["lang", "source"]).aggregate([("row", "min")])
        number = {k: i for i, k in enumerate(zip(firsts.column("lang").to_pylist(), firsts.column("source").to_pylist(),
                                                 strict=True))}
        group = np.array([number[k] for k in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)],
                         np.int64)
        langs, sources = firsts.column("lang").combine_chunks(), firsts.column("source").combine_chunks()
        for c in count_terms(raw, at, group, _MEMBERS):
            g = pa.array(c.group)
            yield pa.RecordBatch.from_arrays(
                [langs.take(g), sources.take(g), c.term, pa.array(c.count.astype(np.int64)),
                 pa.array(c.texts.astype(np.int64))], names=["lang", "source", "term", "n", "docs"])

    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.column(2).nbytes
            if size >= CHUNK_BYTES:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def scaled_share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total) exactly: long division by three decimal digits at a time."""
    value, left = _div(count + 1, total), (count + 1) % total
    for _ in range(3):
        step = left * 1000
        value, left = value * 1000 + _div(step, total), step % total
    return F.lit(1) + value


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q)."""
    return _div((p - q) * (p - q), q)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, n_lang, lead) of the kept terms; ``docs`` is (lang, source, text)."""
    counts = docs.mapInArrow(_count_batches, _COUNTS).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    return (counts.withColumn("in_lang", F.sum("docs").over(term)).withColumn("n_lang", F.sum("n").over(term))
            .withColumn("lead", (F.row_number().over(term.orderBy("source")) == 1).cast("long"))
            .where(F.col("in_lang") >= MIN_DOCS).select("lang", "source", "term", "n", "n_lang", "lead"))


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, terms, total_lang, vocabulary) of every occurring group."""
    seen = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("terms"), F.sum("lead").alias("lead"))
    groups = docs.select("lang", "source").distinct().join(seen, ["lang", "source"], "left").fillna(0)
    langs = groups.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.sum("lead").alias("vocabulary"))
    return groups.join(langs, "lang").select(
        "lang", "source", (F.col("n") + F.col("vocabulary")).alias("total"), "terms",
        (F.col("n_lang") + F.col("vocabulary")).alias("total_lang"), "vocabulary")


def _np_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class PairSums:
    """Sums by a pair of source numbers, added up exactly in sorted arrays."""

    def __init__(self):
        self.codes, self.values, self.size = [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> None:
        self.codes.append((a.astype(np.int64) << 32) | b)
        self.values.append(value)
        self.size += len(value)
        if self.size >= MAX_SUMS:
            self.reduce()

    def reduce(self) -> None:
        if self.codes:
            codes, values = np.concatenate(self.codes), np.concatenate(self.values)
            order = np.argsort(codes, kind="stable")
            codes, values = codes[order], values[order]
            at = run_starts(codes)
            self.codes, self.values = [codes[at]], [np.add.reduceat(values, at)]
            self.size = len(at)


def _pair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, item, value): corrections for the terms that two sources share; rows sorted by (lang, term)."""
    names: dict[tuple, int] = {}
    sums, held, size = PairSums(), [], 0

    def work(rows: pa.Table) -> None:
        keys = zip(rows.column("lang").to_pylist(), rows.column("source").to_pylist(), strict=True)
        source = np.array([names.setdefault(k, len(names)) for k in keys], np.int64)
        p, zero = (rows.column(c).to_numpy() for c in ("p", "p0"))
        term = np.cumsum(rows.column("fresh").to_numpy())
        i = np.arange(len(p))
        for d in range(1, len(p)):  # as far as the largest number of sources of a term
            i = i[i + d < len(p)]
            i = i[term[i + d] == term[i]]
            if not len(i):
                break
            for a, b in ((i, i + d), (i + d, i)):
                value = (_np_distance(p[a], p[b]) - _np_distance(p[a], zero[b]) - _np_distance(zero[a], p[b])
                         + _np_distance(zero[a], zero[b]))
                sums.add(source[a], source[b], value)

    def out():
        sums.reduce()
        if sums.codes and len(sums.codes[0]):
            label = list(names)
            a, b = (sums.codes[0] >> 32).tolist(), (sums.codes[0] & 0xFFFFFFFF).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([label[x][0] for x in a], pa.string()), pa.array([label[x][1] for x in a], pa.string()),
                 pa.array([label[x][1] for x in b], pa.string()), pa.array(sums.values[0])],
                names=["lang", "source", "item", "value"])

    last = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        keys = list(zip(t.column("lang").to_pylist(), t.column("term").to_pylist(), strict=True))
        fresh = [k != prev for k, prev in zip(keys, [last, *keys[:-1]], strict=True)]
        last = keys[-1]
        held.append(t.append_column("fresh", pa.array(np.array(fresh, np.int64))))
        size += b.num_rows
        if size >= 1 << 16:
            rows = pa.concat_tables(held)
            starts = np.flatnonzero(rows.column("fresh").to_numpy())
            cut = int(starts[-1]) if len(starts) else 0  # the last term may go on
            if cut:
                work(rows.slice(0, cut))
                held, size = [rows.slice(cut)], rows.num_rows - cut
            if sums.size >= MAX_SUMS:
                yield from out()
                sums = PairSums()
    if held:
        work(pa.concat_tables(held))
    yield from out()


def pair_divergence(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language.

    The sum over all kept terms of distance(p, q) is: over the source's own
    terms against the other's share of an absent term, over the other's
    terms likewise, both shares of absent terms for all remaining ones, and
    the corrections for shared terms.
    """
    shared = (shares.select("lang", "term", "source", "p", "p0").repartition("lang", "term")
              .sortWithinPartitions("lang", "term")
              .mapInArrow(_pair_batches, "lang string, source string, item string, value long"))
    absent = groups.where(F.col("vocabulary") > 0).select("lang", "source", "terms", "vocabulary", scaled_share(
        F.lit(0).cast("long"), F.col("total")).alias("p0"))
    # Sources have few different counts: one row for each share and its number of terms.
    usual = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    other = absent.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("terms").alias("their"))
    facing = usual.join(other, "lang").where(F.col("source") != F.col("item")).groupBy("lang", "source", "item").agg(
        F.sum(F.col("times") * distance(F.col("p"), F.col("q0"))).alias("own"),
        F.sum(F.col("times") * distance(F.col("q0"), F.col("p"))).alias("theirs"))
    one = lambda source, item, value: F.struct(
        F.col(source).alias("source"), F.col(item).alias("item"), F.col(value).alias("value"))
    sides = facing.select("lang", F.inline(F.array(one("source", "item", "own"), one("item", "source", "theirs"))))
    rest = absent.join(other, "lang").where(F.col("source") != F.col("item")).select(
        "lang", "source", "item", ((F.col("vocabulary") - F.col("terms") - F.col("their"))
                                   * distance(F.col("p0"), F.col("q0"))).alias("value"))
    every = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where(
        F.col("source") != F.col("item")).select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    union = every.unionByName(shared).unionByName(sides).unionByName(rest)
    return union.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
                      source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): sources by distance (``pair``) and telling terms (``term``)."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    src = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), empty(text_col).alias("text"))
    kept = written(term_counts(src), "kept-terms")
    groups = written(group_totals(src, kept), "groups")
    none = F.lit(0).cast("long")
    shares = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", scaled_share(F.col("n"), F.col("total")).alias("p"),
        scaled_share(none, F.col("total")).alias("p0"), scaled_share(F.col("n_lang"), F.col("total_lang")).alias("q"))
    telling = shares.where(F.col("p") > F.col("q")).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        distance(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    top = telling.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP_TERMS)
    pairs = (pair_divergence(shares, groups).withColumn("part", F.lit("pair"))
             .withColumn("rank", F.row_number().over(order)))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(top.select(*columns))


def oracle_sql() -> str:
    """The same rows in DuckDB SQL: every group holds every kept term, every pair every term."""
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts
  FROM documents),
t AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
f AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n
  FROM g JOIN k ON g.lang = k.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (
  SELECT *, 1 + ({SCALE} * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source)
                                        + count(*) OVER (PARTITION BY lang, source))::HUGEINT AS p
  FROM f),
l AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM f GROUP BY lang, term),
q AS (
  SELECT lang, term, 1 + ({SCALE} * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang))::HUGEINT AS q
  FROM l),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source),
pair_rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
term_rows AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, (((p.p - q.q) * (p.p - q.q)) // q.q)::BIGINT AS value
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pair_rows UNION ALL SELECT * FROM term_rows))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
