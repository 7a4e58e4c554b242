import random
from collections import defaultdict

import pytest
from helpers import corpus, docs_frame, lower, prose, words

from shelfrate.llm import near_dup
from shelfrate.llm.near_dup import near_duplicates


def brute(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = words(lower(t))
        sets[i] = {tuple(w)} if 0 < len(w) < size else {tuple(w[k:k + size]) for k in range(len(w) - size + 1)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_matches_brute_force(spark, size, percent):
    rows = corpus(seed=9)
    got = {r.doc_id: r for r in near_duplicates(docs_frame(spark, rows), size, percent).collect()}
    want = brute(rows, size, percent)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_large_group_of_near_copies(spark):
    """Many copies of one text with a few words changed, beside unrelated texts."""
    rng = random.Random(3)
    base = prose(rng, 200, 10**6).split()
    rows = [(i, prose(rng, 120, 10**6)) for i in range(50)]
    for i in range(50, 350):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in near_duplicates(docs_frame(spark, rows), 3, 85).collect()}
    want = brute(rows, 3, 85)
    assert got == {i: w[1] for i, w in want.items()}


def variants(rng, n, size, percent, n_words=150):
    """A text and n variants that are each just near enough to the text, so hardly ever near each other."""
    base = prose(rng, n_words, 10**6).split()
    of = lambda w: {tuple(w[k:k + size]) for k in range(len(w) - size + 1)}
    own, out = of(base), [" ".join(base)]
    for _ in range(n):
        w = list(base)
        for at in rng.sample(range(n_words), n_words):
            one = [*w[:at], f"edit{rng.randrange(10**7)}", *w[at + 1:]]
            if 100 * len(of(one) & own) < percent * len(of(one) | own):
                break
            w = one
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_star_shaped_groups(spark, size, percent):
    """Groups of 10 to 60 different variants of one text."""
    rng = random.Random(11)
    texts = [t for n in (10, 15, 20, 25, 30, 30, 30, 31, 33, 40, 60) for t in variants(rng, n, size, percent)]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in near_duplicates(docs_frame(spark, rows), size, percent).collect()}
    want = brute(rows, size, percent)
    assert got == {i: w[1] for i, w in want.items()}


def test_nulls_repeats_and_empty_table(spark):
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (None, None), (9, None), (8, "x y")]
    got = near_duplicates(docs_frame(spark, rows), 3, 85).collect()
    parts = defaultdict(list)
    for r in got:
        parts[r.doc_id].append((r.component_id, r.kept))
    assert parts[7] == [(7, True)] * 2 and parts[9] == [(9, True)] and parts[8] == [(8, True)]
    assert sorted(map(str, parts[None])) == sorted(map(str, [(7, False), (None, True)]))
    assert near_duplicates(docs_frame(spark, rows).limit(0)).count() == 0


def test_one_of_each_keeps_every_unrelated_text(spark):
    rng = random.Random(14)
    a, b, c = (prose(rng, 60, 10**6) for _ in range(3))
    rows = [(1, a, "fr"), (2, a + " x", "en"), (2, b, "en"), (2, b, "de"), (2, b.upper(), "en"), (3, b + " y", "en"),
            (None, c, "en"), (None, c, "de"), (None, c.upper(), "en"), (None, a, "en"), (4, "", "en"), (4, "", "en"), (5, None, "en"),
            (4, " ", "en"), (None, "", "en"), (None, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    from shelfrate.llm.near_dup import one_of_each
    got = sorted(((r.doc_id, r.text, r.lang) for r in one_of_each(docs).collect()), key=str)
    again = sorted(((r.doc_id, r.text, r.lang) for r in one_of_each(docs.repartition(7)).collect()), key=str)
    assert got == again  # the choice does not change from run to run
    texts = sorted((str(i), (t or "").lower().strip()) for i, t, _ in got)
    assert texts == sorted([("1", a), ("2", b), ("None", c), ("4", ""), ("4", ""), ("5", ""), ("None", "")])
    assert all(lang == "de" for i, t, lang in got if t in (b, c))
    assert one_of_each(docs.limit(0)).columns == docs.columns and one_of_each(docs.limit(0)).count() == 0


def test_large_regions_lose_no_link(spark, monkeypatch):
    """Regions far larger than what is compared in order, without hubs: pairs of variants of one text, in tiles of a few nodes."""
    monkeypatch.setattr(near_dup, "FULL", 3)
    monkeypatch.setattr(near_dup, "REACH", 1)
    monkeypatch.setattr(near_dup, "DENSE", 10**6)
    monkeypatch.setattr(near_dup, "TILE", 7)
    rng = random.Random(21)
    base = prose(rng, 120, 10**6).split()
    texts = []
    for _ in range(40):  # far enough from the base and each other, with a near partner
        w = list(base)
        for at in rng.sample(range(120), 9):
            w[at] = f"edit{rng.randrange(10**7)}"
        texts += [" ".join(w), " ".join([*w[:-2], f"edit{rng.randrange(10**7)}", w[-1]])]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs_frame(spark, rows), 3, 85).collect()}
    want = {i: w[1] for i, w in brute(rows, 3, 85).items()}
    assert got == want and len(set(want.values())) >= 30


def test_variants_of_one_text_make_few_pairs(spark, monkeypatch):
    """Variants of one text that are hardly near each other: all regions are large, the pairs grow as the variants do."""
    for name, value in (("FULL", 3), ("REACH", 1), ("DENSE", 10**6)):
        monkeypatch.setattr(near_dup, name, value)
    compared, compare = [], near_dup.compare

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return compare(pairs, *rest)

    monkeypatch.setattr(near_dup, "compare", counted)
    rng = random.Random(5)
    base = prose(rng, 150, 10**6).split()
    rows = []
    for i in range(90):
        w = list(base)
        for at in rng.sample(range(150), 5):
            w[at] = f"edit{rng.randrange(10**7)}"
        rows.append((i, " ".join(w)))
    rows += [(90, " ".join([*rows[40][1].split()[:-1], "other"])), (91, " ".join(["other", *rows[3][1].split()[1:]]))]
    got = {r.doc_id: r.component_id for r in near_duplicates(docs_frame(spark, rows), 3, 85).collect()}
    want = {i: w[1] for i, w in brute(rows, 3, 85).items()}
    assert got == want and len(set(want.values())) >= 80
    assert sum(compared) < 20 * len(rows)


@pytest.mark.parametrize("percent", [80, 85, 50])
def test_blocks_hold_every_near_pair(percent):
    """The chosen places miss a pair with the stated probability; a lower similarity takes all places."""
    p, places = percent / 100, near_dup.shared_values(percent)
    hit = 0.0
    for mask in range(2**5):
        same = {k for k in range(1, 6) if mask >> (k - 1) & 1}
        if any(same.issuperset(x) for x in places):
            hit += p**len(same) * (1 - p)**(5 - len(same))
    assert (1 - p * hit)**16 <= 1e-10 or len(places) == 10


def _joined(plan):
    """Rows that the joins of an executed plan made."""
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return _joined(plan.executedPlan())
    if plan.getClass().getSimpleName().endswith("QueryStageExec"):
        return _joined(plan.plan())
    own = plan.metrics().apply("numOutputRows").value() if "Join" in plan.nodeName() else 0
    return own + sum(_joined(plan.children().apply(i)) for i in range(plan.children().size()))


def test_nodes_without_links_are_not_looked_up_by_block(spark):
    """Nodes that are linked with none cost the lookup of blocks no rows, a component one for each of its blocks."""
    rng = random.Random(8)
    rows = [(k, f"n{i}", f"n{i}", False) for i in range(300) for k in rng.sample(range(20), 12)]  # one group, not linked
    rows += [(k, f"m{i}", "m0", True) for i in range(40) for k in (100 + i % 3, 103)]  # one component, alone in its blocks
    rows += [(300, f"c{i}", "c0", True) for i in range(40)] + [(300, "d0", "d0", False)]  # one component beside a node
    rows += [(200, "p0", "p0", True), (200, "p1", "p0", True), (200, "q0", "q0", True), (201, "q0", "q0", True), (201, "q1", "q0", True)]
    roots = defaultdict(set)
    for k, _, root, _ in rows:
        roots[k].add(root)
    out = near_dup.beside_others(spark.createDataFrame(rows, "block long, node string, root string, linked boolean"))
    got = sorted((r.node, r.root) for r in out.collect())
    beside = {root for k, _, root, _ in rows if len(roots[k]) > 1}
    assert got == sorted({(node, root) for _, node, root, _ in rows if root in beside})
    assert len(got) == 345 and _joined(out._jdf.queryExecution().executedPlan()) <= 3 + 44  # blocks, then members
