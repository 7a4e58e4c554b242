import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import lower

from shelfrate.llm import divergence
from shelfrate.llm.packed_terms import ASCII_LETTERS, byte_class, count_terms, radix_order, text_bytes

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, term string, n long"


def brute(rows):
    """Dense form: every source holds every kept term."""
    texts = defaultdict(list)
    for _, text, lang, source in rows:
        texts[lang or "", source or ""].append(TERM.findall(lower(text)))
    out = set()
    for lang in {k[0] for k in texts}:
        docs = Counter(w for k, ts in texts.items() if k[0] == lang for t in ts for w in set(t))
        kept = [w for w, c in docs.items() if c >= 3]
        counts = {k[1]: Counter(w for t in ts for w in t) for k, ts in texts.items() if k[0] == lang}
        counts[None] = sum(counts.values(), Counter())

        def share(c, kept=kept):
            total = sum(c[w] for w in kept) + len(kept)
            return {w: 1 + 10**9 * (c[w] + 1) // total for w in kept}
        p = {s: share(c) for s, c in counts.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in p:
            if s is None:
                continue
            pair = [(sum(f(p[s][w], p[o][w]) for w in kept), o) for o in p if o is not None and o != s]
            term = [(f(p[s][w], p[None][w]), w) for w in kept if counts[s][w] and p[s][w] > p[None][w]]
            for part, values, top in (("pair", pair, 10**9), ("term", term, 200)):
                ranked = sorted(values, key=lambda v: (-v[0], v[1].encode()))[:top]
                out |= {(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(ranked)}
    return out


def fixture(n=240):
    rng = random.Random(4)
    pool = ["the", "Été", "of", "abcdefgh", "abcdefghi", "sixteenletterswd", "seventeenletterss", "x" * 40, "é" * 9, "日本"]
    pool += [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(260)]
    rows = []
    for i in range(n):
        words = [rng.choice(pool[:rng.choice((8, 60, 270))]) for _ in range(rng.randrange(0, 30))]
        source = rng.choice(["hot"] * 4 + ["a", "b", "é", None, f"s{i % 7}"])
        rows.append((i, rng.choice([" ", "-9", "\n"]).join(words), rng.choice(["en", "en", "fr", None]), source))
    rows += [(1, "THE the The", "en", "hot")] * 3  # repeated rows are documents of their own
    rows += [(900, None, "en", "empty"), (901, "", "xx", "a"), (902, "only once here", "xx", "b"), (None, "of of", "", None)]
    rows += [(903, "long " * 4000 + "z" * 30000, "fr", "a")] * 3
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize("bound", [1 << 20, 50])
def test_matches_brute_force(spark, monkeypatch, bound):
    """Pair sums held in one go, and handed on in parts."""
    rows = fixture()
    monkeypatch.setattr(divergence, "MAX_SUMS", bound)
    got = divergence.source_divergence(frame(spark, rows).repartition(5)).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == brute(rows)


def test_empty_table_and_languages_without_terms(spark):
    assert divergence.source_divergence(frame(spark, fixture()[:1]).limit(0)).count() == 0
    rows = [(1, "one two", "en", "a"), (2, "one", "en", "b"), (3, None, None, None)]
    got = {tuple(r) for r in divergence.source_divergence(frame(spark, rows)).collect()}
    assert got == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)} == brute(rows)


def test_large_counts_stay_exact(spark):
    n, total = 12_345_678_901_234, 98_765_432_109_876
    row = spark.range(1).select(divergence.scaled_share(divergence.F.lit(n), divergence.F.lit(total)).alias("p")).head()
    assert row.p == 1 + 10**9 * (n + 1) // total


def test_packing_counts_every_length():
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("abÉz", k=rng.choice([1, 7, 8, 9, 15, 16, 17, 31, 32, 33, 70]) // 1))
                      for _ in range(40)) for _ in range(12)] + [None, "", "1234", "tail", "tail", "joined"]
    group = np.array([i % 3 for i in range(len(texts))])
    raw, at = text_bytes(pa.array(texts))
    want, docs = Counter(), Counter()
    for t, g in zip(texts, group.tolist(), strict=True):
        found = TERM.findall(lower(t))
        want.update((g, w) for w in found)
        docs.update({(g, w) for w in found})
    got = {}
    for c in count_terms(raw, at, group, byte_class(ASCII_LETTERS)):
        for g, w, n, d in zip(c.group.tolist(), c.term.to_pylist(), c.count.tolist(), c.texts.tolist(), strict=True):
            assert (g, w) not in got
            got[g, w] = (n, d)
    assert got == {k: (v, docs[k]) for k, v in want.items()}


def test_radix_order_is_a_stable_sort():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 5, 3000, dtype=np.uint64), rng.integers(0, 2**63, 3000, dtype=np.uint64) >> np.uint64(40)
    assert (radix_order(a, b) == np.lexsort((b, a))).all()
    assert len(radix_order(np.zeros(0, np.uint64))) == 0
