import hashlib
import random
import re

import pytest
from helpers import corpus, docs_frame, lower, prose

from shelfrate.llm.decontaminate import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, items):
    w = WORD.findall(lower(text))
    hit, found = set(), set()
    for item, t in items:
        p = WORD.findall(lower(t))
        m = min(10, len(p))
        for i in range(len(p) - m + 1 if m else 0):
            for k in range(len(w) - m + 1):
                if w[k:k + m] == p[i:i + m]:
                    hit.update(range(k, k + m))
                    found.add(item)
    ids = sorted(str(x) for x in found if x is not None)
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


def fixture():
    rng = random.Random(12)
    items = [(i, prose(rng, rng.randrange(1, 40), 30)) for i in range(12)]
    items += [(20, items[0][1]), (21, None), (22, ""), (23, "!!! ..."), (24, "Été à-côté, DÉJÀ vu; x9"), (None, items[3][1])]
    rows = corpus(n=25) + [(900, prose(rng, 50) + " " + items[5][1].upper() + "! " + prose(rng, 9)),
                           (901, items[0][1]), (902, "été, à. côté dÉjÀ-VU x9 été à côté"), (903, items[7][1] * 2)]
    return items, rows


@pytest.mark.parametrize("bound", [1 << 20, 200])
def test_matches_brute_force(spark, bound):
    """One pass over all items, and several passes when the patterns exceed the bound."""
    items, rows = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_frame(spark, rows + [(None, items[5][1])])
    got = decontaminate(docs, bench, carry=("lang",), max_pattern_bytes=bound).collect()
    assert len(got) == len(rows) + 1 and {r.lang for r in got} == {"en"}
    want = dict(rows) | {None: items[5][1]}
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(want[r.doc_id], items)


def test_repeats_and_empty_tables(spark):
    items, rows = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_frame(spark, [rows[-1], rows[-1]])
    assert len({str(r) for r in decontaminate(docs, bench).collect()}) == 1
    assert decontaminate(docs, bench).count() == 2
    assert decontaminate(docs.limit(0), bench).count() == 0
    assert {r.n_hit for r in decontaminate(docs, bench.limit(0)).collect()} == {0}
