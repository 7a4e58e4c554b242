import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import corpus, docs_frame, lower, prose

from shelfrate.llm import ranked_search as search
from shelfrate.llm.packed_terms import TermIndex, stretches, text_bytes
from shelfrate.llm.ranked_search import Best, Block, mask_words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, items, top=50):
    docs = [(i, TERM.findall(lower(t))) for i, t in rows]
    docs = [(i, w, Counter(w)) for i, w in docs if w]
    n_docs, n_terms = len(docs), sum(len(w) for _, w, _ in docs)
    df = Counter(t for _, _, c in docs for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        terms = set(TERM.findall(lower(text)))
        scored = []
        for i, w, c in docs:
            m = 100 - 50 + 50 * len(w) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        for rank, (s, none, i) in enumerate(sorted(scored)[:top], 1):
            out.append((item, rank, None if none else i, -s))
    return sorted(out, key=str)


def fixture():
    rng = random.Random(31)
    items = [(i, prose(rng, rng.randrange(1, 90), 60)) for i in range(14)]
    items += [(20, items[0][1]), (20, "w1x1 w2x2"), (20, "w1x1 w2x2"), (21, None), (22, ""), (23, "!! ..."), (None, "one W3x3"),
              (24, "Été_à-côté 42 " + "l" * 40), (25, "nowhere " * 3), (26, " ".join(f"w{i}x{i % 9}" for i in range(200)))]
    rows = corpus(n=70) + [(800 + i, prose(rng, rng.randrange(1, 60), 60)) for i in range(150)]
    rows += [(7, "w1x1 w2x2"), (7, "w1x1 w2x2"), (None, "w1x1 w2x2 one"), (999, "l" * 40 + " été 42 " * 9), (998, "l" * 41)]
    return items, rows


@pytest.mark.parametrize("bound", [1 << 20, 900])
def test_matches_brute_force(spark, monkeypatch, bound):
    """All items in one pass, and in several parts."""
    items, rows = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = search.ranked_search(docs_frame(spark, rows).repartition(3), bench, max_query_bytes=bound).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, [x for x in items if x[1] is not None])


def test_small_blocks_and_rounds_rank_alike(spark, monkeypatch):
    items, rows = fixture()
    for name, value in (("BLOCK_DOCS", 40), ("CHUNK_BYTES", 500), ("MAX_BITS", 1)):
        monkeypatch.setattr(search, name, value)
    monkeypatch.setattr(Block.rank, "__defaults__", (1,))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = search.ranked_search(docs_frame(spark, rows).coalesce(1), bench, top=5).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, [x for x in items if x[1] is not None], top=5)


def test_empty_tables_and_clashing_columns(spark):
    items, rows = fixture()
    bench = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, doc_id long, score string")
    docs = docs_frame(spark, rows)
    clash = docs.selectExpr("*", "1 AS rank", "2 AS score", "'x' AS item_id")
    assert search.ranked_search(docs.limit(0), bench).count() == 0
    assert search.ranked_search(docs, bench.limit(0)).count() == 0
    assert search.ranked_search(clash, bench).columns == ["item_id", "rank", "doc_id", "score"]


def _block(rng, n, terms):
    at, term, count = [0], [], []
    for _ in range(n):
        own = np.flatnonzero(rng.random(terms) < rng.choice([0.02, 0.3]))
        term += own.tolist()
        count += rng.integers(1, 4, len(own)).tolist()
        at.append(len(term))
    stats = {"docs": 5 * n, "terms": 700 * n, "weight": rng.integers(1, 9000, terms)}
    return Block(pa.array(np.arange(n)), rng.integers(50, 400, n), np.array(at), np.array(term, np.int64),
                 np.array(count, np.int64), stats)


def test_descending_masks_skip_documents_and_lose_none():
    rng = np.random.default_rng(6)
    block = _block(rng, 3000, 90)
    for k in (3, 20, 80):
        wanted = np.sort(rng.choice(90, k, replace=False))
        few, every = Best(20), Best(3000)
        scored = block.rank(wanted, few, first_round=32)
        assert block.rank(wanted, every, first_round=10**6) >= scored
        assert few.score.tolist() == every.score[:20].tolist() and few.id.tolist() == every.id[:20].tolist()
        assert k > 3 or scored < 1500  # most masks are never scored


def test_masks_and_lookup():
    rng = np.random.default_rng(2)
    bits = rng.random((131, 50)) < 0.5
    words = mask_words(bits)
    assert len(words) == 3
    same = {tuple(w[i] for w in words) for i in range(50)}
    assert len(same) == len({tuple(bits[:, i]) for i in range(50)})
    raw, at = text_bytes(pa.array(["Alpha beta " + "x" * 9 + " " + "y" * 70, None, "beta alphas é"]))
    starts, ends, _ = stretches(raw, at, search._MEMBERS)
    index = TermIndex([b"beta", b"alpha", b"x" * 9, b"y" * 70, "é".encode(), b"zz"])
    assert index.find(raw, starts, ends).tolist() == [1, 0, 2, 3, 0, -1, 4]
    assert TermIndex([]).find(raw, starts, ends).tolist() == [-1] * 7
    assert search._share(np.array([10**12]), 10**11, 10**14).tolist() == [10**9]
