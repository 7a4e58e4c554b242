"""Language-model scoring by prediction by partial matching.

The model is a byte-context trie of order ``ORDER`` over all training texts.
A symbol (a byte or the end of the text) is coded in the longest context that
was seen: with its count over the context's total if it was seen there, else
with an escape whose weight is the number of distinct symbols, and on to the
context shorter by a byte, where the symbols of the longer one are excluded
from counts and escapes. Below the empty context all symbols left over are
equally likely. A text's score is the sum of log10 probabilities.

The trie is not a structure in one memory but tables by level: a node is a
context and symbol packed into a long, with its count. As every occurrence
of a context is one of its suffix too, the symbols excluded at a level are
the children of the context above, so a level needs three numbers for each
context: total, distinct symbols, and the total that its children have in
the suffix. The code of a symbol depends on ``ORDER`` bytes before it and on
itself, so each distinct such string is coded once, level by level, by joins.

Texts are written in chunks of ``CHUNK_BYTES``. Each chunk asks for the
strings and words that occur in it (once each), the answers meet the chunk
again, and one task scores its texts. So the tables grow with the corpus, and
a task holds one chunk and its own strings only.

Edge cases: a null text is empty, and an empty text is an end only; rows
with a null id train the model; repeated rows train and are scored each; an
unseen word or byte has a finite score, also without any training text; a
very long text is a chunk of its own, scored in slices; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfrate.llm.common import written
from shelfrate.llm.packed_terms import run_starts, text_bytes
from shelfrate.llm.tokens import hashed_words

ORDER, FOLDS, SMOOTH = 4, 10, 0.1
# Symbols: bytes, the end of a text, and what stands before its first byte.
END, START, SYMBOL_BITS, ALPHABET = 256, 257, 9, 257
CHUNK_BYTES = 16 << 20
# Bytes of texts whose strings are in memory at a time.
SLICE_BYTES = 2 << 20

_OUT = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
        "score double")


def held_out(id_col: Column) -> Column:
    """True for the rows whose crc32 of the id as text is 0 modulo ``FOLDS``."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the number of their chunk."""
    chunk, size = TaskContext.get().partitionId() << 32, 0
    for b in batches:
        sizes = b.column(2).nbytes
        if size and size + sizes > CHUNK_BYTES:
            chunk, size = chunk + 1, 0
        size += sizes
        yield pa.RecordBatch.from_arrays([pa.array([chunk] * b.num_rows, pa.int64()), *b.columns],
                                         names=["chunk", *b.schema.names])


def slices(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts (first, last) of about ``SLICE_BYTES`` each."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE_BYTES, side="right")) - 1)
        yield i, j
        i = j


def grams(raw: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of the texts (an end after each): the ``order`` symbols before it and itself; its text."""
    n = len(at) - 1
    width = np.diff(at) + order + 1
    begin = np.cumsum(width) - width
    symbols = np.full(int(width.sum()), START, np.uint64)
    text = np.repeat(np.arange(n), np.diff(at))
    symbols[np.arange(len(raw)) - at[text] + begin[text] + order] = raw
    symbols[begin + width - 1] = END
    value = np.zeros(len(symbols) - order, np.uint64)
    for j in range(order + 1):
        value = (value << np.uint64(SYMBOL_BITS)) | symbols[j:len(symbols) - order + j]
    own = symbols[order:] != START
    return value[own], np.repeat(np.arange(n), width - order)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = run_starts(keys)
    return keys[at], np.add.reduceat(n, at) if len(at) else n


def chunk_grams(raw: np.ndarray, at: np.ndarray, trains: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings of some texts, and how often each occurs in the training texts among them."""
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for i, j in slices(raw, at):
        value, text = grams(raw[at[i]:at[j]], at[i:j + 1] - at[i], order)
        marked, count = np.unique((value << np.uint64(1)) | trains[i:j][text].astype(np.uint64), return_counts=True)
        parts.append((marked >> np.uint64(1), np.where(marked & np.uint64(1), count, 0)))
    return _summed(*[np.concatenate(c) for c in zip(*parts, strict=True)])


def chunk_words(raw: np.ndarray, at: np.ndarray, trains: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Hash, bytes and training occurrences of the distinct words of some texts."""
    data = raw.tobytes()
    texts = [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    hashes, offsets = hashed_words(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    order = np.argsort(hashes, kind="stable")
    first = run_starts(hashes[order])
    n = np.add.reduceat(trains[text[order]].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    lead = order[first]
    words: list[bytes] = [b""] * len(lead)
    by_text = np.argsort(lead, kind="stable")
    split, own = [], -1
    for k, t, place in zip(by_text.tolist(), text[lead[by_text]].tolist(), lead[by_text].tolist(), strict=True):
        if t != own:
            split, own = texts[t].split(), t
        words[k] = split[place - offsets[t]]
    return hashes[lead], words, n


def _by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each chunk (of a part of one, where a file was split)."""
    held, chunk = [], None
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and ids[lo] != chunk:
                yield chunk, pa.Table.from_batches(held).combine_chunks()
                held = []
            chunk = int(ids[lo])
            held.append(b.slice(lo, hi - lo))
    if held:
        yield chunk, pa.Table.from_batches(held).combine_chunks()


def _column(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name).combine_chunks()
    return c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks)


def _gram_rows(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, t in _by_chunk(batches):
            keys, n = chunk_grams(*text_bytes(_column(t, "text")), np.array(_column(t, "trains")), order)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), chunk)), pa.array(keys.view(np.int64)),
                                              pa.array(n)], names=["chunk", "gram", "n"])
    return run


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk, t in _by_chunk(batches):
        keys, words, n = chunk_words(*text_bytes(_column(t, "text")), np.array(_column(t, "trains")))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), chunk)), pa.array(keys.view(np.int64)),
                                          pa.array(words, pa.binary()), pa.array(n)], names=["chunk", "key", "word", "n"])


def trie_levels(counts: DataFrame, order: int) -> list[tuple[DataFrame, DataFrame]]:
    """For each level from 0 to ``order``: nodes (gram, c) and contexts (context, total, distinct, below).

    ``counts`` is (gram, n) of the training texts. ``below`` is the total of
    a context's children in the context shorter by a byte.
    """
    nodes = {order: counts.where(F.col("n") > 0).select("gram", F.col("n").alias("c"))}
    for level in range(order - 1, -1, -1):
        shorter = F.col("gram").bitwiseAND((1 << SYMBOL_BITS * (level + 1)) - 1)
        nodes[level] = written(nodes[level + 1].groupBy(shorter.alias("gram")).agg(F.sum("c").alias("c")), f"level{level}")
    out = []
    for level in range(order + 1):
        rows, below = nodes[level], F.lit(0).cast("long")
        if level:
            suffix = F.col("gram").bitwiseAND((1 << SYMBOL_BITS * level) - 1)
            rows = rows.withColumn("suffix", suffix).join(
                nodes[level - 1].select(F.col("gram").alias("suffix"), F.col("c").alias("shorter")), "suffix")
            below = F.sum("shorter")
        out.append((nodes[level], rows.groupBy(F.shiftright("gram", SYMBOL_BITS).alias("context")).agg(
            F.sum("c").alias("total"), F.count("*").alias("distinct"), below.alias("below") if level else
            F.max(below).alias("below"))))
    return out


def code_grams(wanted: DataFrame, levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(gram, code): log10 probability of the last symbol of every wanted string after the symbols before it."""
    zero = F.lit(0).cast("long")
    left = wanted.select("gram", F.lit(0.0).alias("code"), zero.alias("gone"), zero.alias("gone_total"))
    done = None
    for level in range(len(levels) - 1, -1, -1):
        nodes, contexts = levels[level]
        key = F.col("gram").bitwiseAND((1 << SYMBOL_BITS * (level + 1)) - 1)
        step = (left.withColumn("own", key).withColumn("context", F.shiftright(key, SYMBOL_BITS))
                .join(nodes.select(F.col("gram").alias("own"), "c"), "own", "left").join(contexts, "context", "left"))
        # Symbols of the longer context are excluded from total and escapes.
        total = F.coalesce("total", zero) - F.col("gone_total")
        escapes = F.coalesce("distinct", zero) - F.col("gone")
        weight = F.when(F.col("c").isNotNull(), F.col("c")).otherwise(escapes)
        step = written(step.select(
            "gram", F.when(weight > 0, F.col("code") + F.log10(weight / (total + escapes))).otherwise(F.col("code")).alias("code"),
            F.coalesce("distinct", zero).alias("gone"), F.coalesce("below", zero).alias("gone_total"),
            F.col("c").isNotNull().alias("found")), f"coded{level}")
        found = step.where("found").select("gram", "code")
        done = found if done is None else done.unionByName(found)
        left = step.where(~F.col("found")).drop("found")
    rest = left.select("gram", (F.col("code") - F.log10(F.lit(ALPHABET) - F.col("gone"))).alias("code"))
    return done.unionByName(rest)


def _scored(order: int, known_end: int, n_train: int, n_distinct: int):
    base = SMOOTH * (n_distinct + 1) + n_train

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        kind, key = _column(answers, "kind").to_numpy(), _column(answers, "key").to_numpy().view(np.uint64)
        value = _column(answers, "value").to_numpy()
        tables = []
        for k in (0, 1):  # strings, words
            keys, first = np.unique(key[kind == k], return_index=True)
            tables.append((keys, value[kind == k][first]))
        raw, at = text_bytes(_column(docs, "text"))
        n = docs.num_rows
        score, base_score = np.zeros(n), np.zeros(n)
        tokens, known = np.ones(n, np.int64), np.full(n, int(known_end > 0), np.int64)
        for i, j in slices(raw, at):
            part, offsets = raw[at[i]:at[j]], at[i:j + 1] - at[i]
            gram, text = grams(part, offsets, order)
            score[i:j] = np.bincount(text, weights=tables[0][1][np.searchsorted(tables[0][0], gram)], minlength=j - i)
            data, cuts = part.tobytes(), offsets.tolist()
            hashes, where = hashed_words([data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
            text = np.repeat(np.arange(j - i), np.diff(where))
            c = tables[1][1][np.searchsorted(tables[1][0], hashes)] if len(hashes) else np.zeros(0)
            tokens[i:j] += np.diff(where)
            known[i:j] += np.bincount(text[c > 0], minlength=j - i)
            base_score[i:j] = np.bincount(text, weights=np.log10((c + SMOOTH) / base), minlength=j - i)
        base_score += np.log10((known_end + SMOOTH) / base)
        return pa.table([_column(docs, "doc_id"), _column(docs, "held_out"), pa.array(tokens), pa.array(known),
                         pa.array(np.full(n, n_train)), pa.array(base_score), pa.array(score)],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def score_texts(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chunks = written(src.mapInArrow(_chunked, "chunk long, doc_id long, held_out boolean, text string"), "chunks", "zstd")
    texts = chunks.select("chunk", "text", (~F.col("held_out")).alias("trains"))

    word = Window.partitionBy("word")
    words = texts.mapInArrow(_word_rows, "chunk long, key long, word binary, n long")
    words = written(words.withColumn("c", F.sum("n").over(word)).select(
        "chunk", "key", "c", (F.row_number().over(word.orderBy("chunk", "key")) == 1).alias("lead")), "word-counts")
    zero = F.lit(0).cast("long")
    n_words, n_distinct = words.where(F.col("lead") & (F.col("c") > 0)).agg(
        F.coalesce(F.sum("c"), zero), F.count("*")).head()
    ends = texts.where("trains").count()

    rows = written(texts.mapInArrow(_gram_rows(order), "chunk long, gram long, n long"), "grams")
    counts = written(rows.groupBy("gram").agg(F.sum("n").alias("n")), "gram-counts")
    codes = code_grams(counts, trie_levels(counts, order))
    answers = rows.join(codes, "gram").select("chunk", F.lit(0).alias("kind"), F.col("gram").alias("key"),
                                              F.col("code").alias("value"))
    answers = answers.unionByName(words.select("chunk", F.lit(1).alias("kind"), "key", F.col("c").cast("double").alias("value")))
    scored = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _scored(order, ends, n_words + ends, n_distinct + (ends > 0)), _OUT)
    return scored.withColumnRenamed("doc_id", id_col)
