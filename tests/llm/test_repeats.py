"""Substring and suffix-array de-duplication against brute force."""

import hashlib
import random

import numpy as np
import pytest
from helpers import corpus, docs_frame, prose, words

from shelfrate.llm import repeats, winnow
from shelfrate.llm.substring_dedup import remove_repeats
from shelfrate.llm.suffix_array import previous_factors
from shelfrate.llm.suffix_dedup import remove_repeated_bytes


def mask_of(seqs, length, keep_first):
    """{id: mask} of the symbols covered by repeated windows."""
    count = {}
    for s in seqs.values():
        for k in range(len(s) - length + 1):
            count[s[k:k + length]] = count.get(s[k:k + length], 0) + 1
    seen, out = set(), {}
    for i in sorted(seqs):
        s, m = seqs[i], np.zeros(len(seqs[i]), bool)
        for k in range(len(s) - length + 1):
            key = s[k:k + length]
            if (key in seen) if keep_first else count[key] > 1:
                m[k:k + length] = True
            seen.add(key)
        out[i] = m
    return out


def check_words(spark, rows, length=20, gram=6):
    got = {r.doc_id: r for r in remove_repeats(docs_frame(spark, rows), length, gram, with_text=True).collect()}
    seqs = {i: tuple(words(t)) for i, t in rows}
    for i, m in mask_of(seqs, length, True).items():
        kept = " ".join(w for w, g in zip(seqs[i], m, strict=True) if not g)
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept, r.kept_sha256) == (
            len(m), int(m.sum()), kept, hashlib.sha256(kept.encode()).hexdigest())


def check_bytes(spark, rows, keep_first, length=200, gram=64):
    got = {r.doc_id: r for r in remove_repeated_bytes(docs_frame(spark, rows), length, gram, keep_first).collect()}
    seqs = {i: (t or "").encode() for i, t in rows}
    for i, m in mask_of(seqs, length, keep_first).items():
        kept = np.frombuffer(seqs[i], np.uint8)[~m].tobytes()
        n_spans = int((np.diff(np.concatenate(([0], m.astype(int)))) == 1).sum())
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (
            len(m), int(m.sum()), n_spans, hashlib.sha256(kept).hexdigest())


def shared_passages(seed=11, n=120):
    """Many different texts around a few shared passages: anchors with many contexts."""
    rng = random.Random(seed)
    passages = [prose(rng, 60, 10**6) for _ in range(3)]
    return [(i, " ".join([prose(rng, rng.randrange(3, 40), 50), rng.choice(passages), prose(rng, rng.randrange(0, 30), 50)]))
            for i in range(n)]


def test_words(spark):
    check_words(spark, corpus())


@pytest.mark.parametrize("keep_first", [True, False])
def test_bytes(spark, keep_first):
    check_bytes(spark, corpus(), keep_first)


@pytest.mark.parametrize("contexts,group", [(64, 4096), (1, 4096), (64, 2), (3, 8)])
def test_every_way_of_comparing(spark, monkeypatch, contexts, group):
    """Small bounds send the same places through the marks and the spread comparison."""
    monkeypatch.setattr(repeats, "MAX_CONTEXTS", contexts)
    monkeypatch.setattr(repeats, "MAX_GROUP", group)
    seeds = [(g, c, d, p) for g in range(3) for c in range(6) for d in range(4) for p in range(2)]
    cols = [np.array(x) for x in zip(*seeds, strict=True)]
    for keep_first in (True, False):
        out = repeats.combine(cols[0].astype(np.uint64), (cols[1] + 10 * cols[0]).astype(np.uint64), cols[2], cols[3], keep_first)
        go = {k: v[out["state"] == 0] for k, v in out.items()}
        done = {(d, p, g) for g, d, p, s in zip(out["gram"], out["doc"], out["pos"], out["state"], strict=True) if s}
        if len(go["gram"]):
            gram, doc, pos, _ = repeats.decide(go["gram"], go["context"], go["doc"], go["pos"], go["places"], keep_first)
            done |= {(d, p, g) for g, d, p in zip(gram, doc, pos, strict=True)}
        # Every gram has several contexts, so every place is either repeated or compared.
        assert len(done) == len({(d, p, g) for g, _, d, p in seeds})


def test_words_with_many_contexts(spark):
    check_words(spark, shared_passages(n=200))


@pytest.mark.parametrize("keep_first", [True, False])
def test_bytes_with_many_contexts(spark, keep_first):
    check_bytes(spark, shared_passages(n=200), keep_first)


def test_long_text_in_pieces(monkeypatch):
    rng = np.random.default_rng(4)
    values = rng.integers(0, 5, 5000).astype(np.uint64)
    at = np.array([0, 5000])
    whole = winnow.anchor_runs(values, at, 40, 12)
    monkeypatch.setattr(winnow, "SPAN", 300)
    pieces = winnow.anchor_runs(values, at, 40, 12)
    for f in ("doc", "pos", "first", "last", "gram", "context"):
        assert np.array_equal(getattr(whole, f), getattr(pieces, f)), f


@pytest.mark.parametrize("length,letters,n", [(8, 2, 400), (12, 2, 400), (37, 1, 300), (200, 1, 900), (24, 2, 700)])
def test_longest_factors_against_brute_force(length, letters, n):
    """Lengths of the longest earlier and later factors, cut at ``length``, for every start and for some."""
    rng = np.random.default_rng(n + length)
    data = rng.integers(0, letters, n).astype(np.uint8)
    data[n // 2:n // 2 + n // 4] = data[:n // 4]
    text = data.tobytes()

    def shared(a, b):
        k = 0
        while k < length and text[a + k] == text[b + k]:
            k += 1
        return k

    every = np.arange(n - length + 1)
    for starts in (every, every[rng.random(len(every)) < 0.3]):
        previous, following = previous_factors(data, starts, length, later=True)
        for i, s in enumerate(starts.tolist()):
            assert previous[i] == max((shared(s, t) for t in starts[:i].tolist()), default=0)
            assert following[i] == max((shared(s, t) for t in starts[i + 1:].tolist()), default=0)


def test_nulls_repeats_and_empty_table(spark):
    text = prose(random.Random(2), 90)
    rows = [(5, text), (5, text), (None, text), (6, None), (7, "")]
    got = remove_repeats(docs_frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("5", 0), ("5", 0), ("6", 0), ("7", 0), ("None", 0)]
    got = remove_repeated_bytes(docs_frame(spark, rows), keep_first=False).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("5", 0), ("5", 0), ("6", 0), ("7", 0), ("None", 0)]
    assert remove_repeats(docs_frame(spark, rows).limit(0)).count() == 0
    assert remove_repeated_bytes(docs_frame(spark, rows).limit(0)).count() == 0


def test_one_id_with_unrelated_texts(spark):
    """Texts of one id keep their own spans: a text without any repeat loses nothing."""
    rng = random.Random(21)
    passage = prose(rng, 45, 10**6)
    u, v, w, x = (c + prose(rng, 30, 10**6) for c in "UVWX")
    rows = [(1, passage + " " + u), (2, passage + " " + v), (2, w), (2, w), (3, x + " " + passage), (None, passage)]
    docs = docs_frame(spark, rows).repartition(3)
    got = {(r.doc_id, r.kept) for r in remove_repeats(docs, with_text=True).collect()}
    assert got == {(1, passage + " " + u), (2, v), (2, w), (3, x), (None, passage)}
    out = remove_repeated_bytes(docs, keep_first=False, with_bytes=True).collect()
    assert len(out) == len(rows)
    kept = {(r.doc_id, bytes(r.kept).decode().strip(), r.n_spans) for r in out}
    assert kept == {(1, u, 1), (2, v, 1), (2, w, 0), (3, x, 1), (None, passage, 0)}


def test_sorted_windows_over_many_partitions(spark):
    """Equal windows over partition ends, repeated places, and both ways of counting the first one."""
    rng = random.Random(5)
    rows = [(rng.randrange(4), rng.randrange(3), rng.randrange(6), rng.randrange(5)) for _ in range(400)]
    df = spark.createDataFrame(rows, "gram long, window long, doc long, start long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for keep_first in (True, False):
            search = repeats.Search(None, 20, 6, keep_first)
            got = {tuple(r) for r in repeats.repeated_windows(df, search).collect()}
            want = set()
            for g, w, d, s in rows:
                places = {(y, z) for a, b, y, z in rows if (a, b) == (g, w)}
                if len(places) > 1 and not (keep_first and (d, s) == min(places)):
                    want.add((d, s))
            assert got == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
