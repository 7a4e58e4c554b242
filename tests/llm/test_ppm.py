import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import corpus, docs_frame, lower, prose, words

from shelfrate.llm import ppm
from shelfrate.llm.packed_terms import text_bytes

END = "end"


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def symbols(text, order):
    return [None] * order + list(lower(text).encode()) + [END]


def trie(texts, order):
    """Context tuple -> counts of the symbols after it."""
    counts = defaultdict(Counter)
    for t in texts:
        s = symbols(t, order)
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[tuple(s[i - k:i])][s[i]] += 1
    return counts


def probability(counts, context, symbol):
    """Walks down the contexts with a set of excluded symbols."""
    p, excluded = 1.0, set()
    for k in range(len(context) + 1):
        seen = {s: c for s, c in counts.get(context[k:], {}).items() if s not in excluded}
        if not seen:
            continue
        total = sum(seen.values()) + len(seen)
        if symbol in seen:
            return p * seen[symbol] / total
        p *= len(seen) / total
        excluded |= set(seen)
    return p / (257 - len(excluded))


def brute(rows, order):
    train = [t for i, t in rows if not held(i)]
    tokens = Counter(w for t in train for w in words(lower(t)))
    if train:
        tokens[END] = len(train)
    n, v, model = sum(tokens.values()), len(tokens), trie(train, order)
    out = []
    for i, t in rows:
        own = [*words(lower(t)), END]
        base = sum(math.log10((tokens[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        s = symbols(t, order)
        score = sum(math.log10(probability(model, tuple(s[k - order:k]), s[k])) for k in range(order, len(s)))
        out.append((i, held(i), len(own), sum(tokens[w] > 0 for w in own), n, base, score))
    return out


def same(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[6], 4))
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-7)


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(ppm, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(ppm, "SLICE_BYTES", 700)


@pytest.mark.parametrize("order", [0, 2, 4, 6])
def test_matches_brute_force(spark, small_chunks, order):
    rng = random.Random(2)
    rows = corpus(n=40) + [(500 + i, prose(rng, 20, 50)) for i in range(30)]
    rows += [(501, "repeated row"), (501, "repeated row"), (501, "another text"), (None, "no id ÀÉ"), (None, None)]
    rows += [(i, f"unseen ☃ {i} qq\x00zz") for i in range(700, 730)]
    same(ppm.score_texts(docs_frame(spark, rows).repartition(4), order=order).collect(), brute(rows, order))


def test_default_chunks_and_clashing_columns(spark):
    rows = corpus(n=20)
    docs = docs_frame(spark, rows).selectExpr("*", "1 AS chunk", "2 AS score", "'x' AS held_out", "3 AS gram", "4 AS key")
    same(ppm.score_texts(docs).collect(), brute(rows, ppm.ORDER))


def test_empty_table_and_no_training_text(spark):
    docs = docs_frame(spark, corpus(n=8))
    assert ppm.score_texts(docs.limit(0)).count() == 0
    only_held = [(i, "some words") for i in range(300) if held(i)][:3]
    got = ppm.score_texts(docs_frame(spark, only_held)).collect()
    same(got, brute(only_held, ppm.ORDER))
    assert {(r.n_known, r.train_tokens) for r in got} == {(0, 0)}
    assert all(abs(r.score + 11 * math.log10(257)) < 1e-9 for r in got)


def test_probabilities_of_a_context_add_up_to_one():
    model = trie(["abracadabra", "abrakadabra bar", ""], 3)
    for context in ((97, 98, 114), (None, None, None), (122, 122, 122), (98, 114, 97)):
        total = sum(probability(model, context, s) for s in [*range(256), END])
        assert abs(total - 1) < 1e-12


def test_prose_is_likelier_than_noise(spark):
    """Held-out texts of the corpus's kind cost fewer bits a byte than letters at random."""
    rng = random.Random(9)
    rows = [(i, prose(rng, 60, 80)) for i in range(200)]
    noise = [i for i in range(1000, 1100) if held(i)]
    rows += [(i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=300))) for i in noise]
    got = {r.doc_id: r.score / len(dict(rows)[r.doc_id]) for r in ppm.score_texts(docs_frame(spark, rows)).collect()}
    own = [s for i, s in got.items() if i < 1000 and held(i)]
    assert own and min(own) > 2 * max(got[i] for i in noise)


def test_strings_of_texts_do_not_cross():
    raw, at = text_bytes(pa.array(["ab", None, "c"]))
    gram, text = ppm.grams(raw, at, 1)
    pairs = [(int(g) >> 9, int(g) & 511) for g in gram]
    assert pairs == [(257, 97), (97, 98), (98, 256), (257, 256), (257, 99), (99, 256)]
    assert text.tolist() == [0, 0, 0, 1, 2, 2]
