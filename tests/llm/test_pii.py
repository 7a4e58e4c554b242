import hashlib
import re

import numpy as np
import pytest
from helpers import docs_frame
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfrate.llm.boosted_trees import as_column, boost, margins, threshold
from shelfrate.llm.pii import FEATURES, KINDS, find_candidates, find_pii, redact_documents

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 8 <= len(digits) <= 15


def brute(text):
    return {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if valid(k, m.group())]
            for k, p in PATTERNS.items()}


TEXTS = [
    "mail a.b+c@x-y.example.com, d@e.f_g@h.i and x@y@z.org.uk; no@dot", "a@b.c@d.e%f@g.h", "@@ a@ @b.c .@-.-",
    "ips 1.2.3.4.5 001.002.003.255 256.1.1.1 1.2.3 9999999999.1.1.1 1.2.3.4", "1.2.3.4" * 3,
    "card 4111 1111 1111 1111 or 4111-1111-1111-1111 4111111111111112 12 4111111111111111 4111  1111",
    "5 4-4 4 - 4", "tel +1 (555) 010-1234, +49.30.1234567- +1+2+3 +12 ++491234567890 +1 234 567 890 123 456",
    "é\U0001f600 +1 (555) 010-1234 \U0001f600 a@b.co", "", None, "plain words only", "9" * 3000, "1 " * 3000,
    "a" * 4000 + "@" + "b." * 2000, "+" * 500 + "1" * 500, "call 555-010-1234 or (555) 010 1234, visa 7536784127813050 4111111111111111"]


def test_strict_spans_match_brute_force(spark):
    rows = list(enumerate(TEXTS)) + [(None, TEXTS[0]), (0, TEXTS[0])]
    got = find_pii(docs_frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(TEXTS[0] if r.doc_id is None else TEXTS[r.doc_id])
        assert [r[f"n_{k}"] for k in KINDS] == [len(want[k]) for k in KINDS], TEXTS[r.doc_id or 0]
        joined = ",".join(x for k in KINDS for x in want[k])
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(x for k in KINDS for x in want[k]) <= set(spans)
        assert len(spans) == sum(len(v) for v in want.values()) + r.n_added


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="a1 .@+-()25é\n", max_size=60), min_size=20, max_size=40))
def test_strict_spans_on_random_texts(spark, texts):
    for r in find_pii(docs_frame(spark, list(enumerate(texts)))).collect():
        want = ",".join(x for v in brute(texts[r.doc_id]).values() for x in v)
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_added_spans_recover_merged_cards(spark):
    """A valid card beside other digits is lost to the strict pattern; the trees bring it back."""
    rows = [(i, f"pay with 4111111111111111 now {i}") for i in range(0, 400, 2)]
    rows += [(i, f"order 7536784127813051 is number {i}") for i in range(1, 400, 2)]
    rows.append((1000, "x 7536784127813051 4111111111111111 y"))
    got = {r.doc_id: r for r in find_pii(docs_frame(spark, rows)).collect()}
    assert got[1000].n_card == 0 and got[1000].spans == "card:19:35"
    assert all(got[i].spans == "" for i in range(1, 400, 2))


@pytest.mark.parametrize("share", [1, 60])
def test_rare_and_frequent_forms_alike(spark, share):
    """Forms that no strict pattern matches are added in one document of 60 and in all; look-alikes never."""
    forms = ["2001:db8:0:1:2:3:4:5", "(555) 010 1234", "a[at]b[dot]org", "378282246310005"]
    rows = [(i, f"on 2024 01 15 10 at 12:34:56:78 1402000000000 see me @ noon. then {i}; mail m{i}@x.org 10.0.0.{i}, "
             f"+1 555 010 12{i + 10}, 4111111111111111" + "".join(f"; {f} x" for f in forms if i < share)) for i in range(60)]
    for r in find_pii(docs_frame(spark, rows)).collect():
        text = rows[r.doc_id][1]
        want = {f"{k}:{text.find(f)}:{text.find(f) + len(f)}" for k, f in zip(("ip", "phone", "email", "card"), forms, strict=True)
                if f in text}
        strict = {x for v in brute(text).values() for x in v}
        assert set(filter(None, r.spans.split(","))) == strict | want


def numbers(prefix, n):
    """Numbers of 15 digits, of which one in ten has a right check digit."""
    return [f"{prefix}{i * 7919 % 10**11:011d}2" for i in range(n)]


def test_context_decides(spark):
    """Order numbers that pass the check by chance are left alone; without the context features they are added."""
    cards = [c for c in numbers("378", 3000) if luhn(c)][:150]
    orders = numbers("371", 300)
    rows = [(i, f"they pay by card {c} today") for i, c in enumerate(cards)]
    rows += [(1000 + i, f"we sent order number {c} today") for i, c in enumerate(orders)]
    frame = docs_frame(spark, rows)
    got = {r.doc_id: r.spans for r in find_pii(frame).collect()}
    assert all(got[i] == "card:17:32" for i in range(150)) and all(got[1000 + i] == "" for i in range(300))
    shape = tuple(f for f in FEATURES if f not in ("left", "right", "prev", "word"))
    blind = {r.doc_id: r.spans for r in find_pii(frame, features=shape).collect()}
    chance = [i for i, c in enumerate(orders) if luhn(c)]
    assert 20 < len(chance) < 40 and all((blind[1000 + i] != "") == (i in chance) for i in range(300))


def test_no_feature_is_the_label(spark):
    """Equal features with either label: a check digit cannot be read from shape and context."""
    rows = [(i, f"see {c} here") for i, c in enumerate(numbers("371", 200))]
    cands = find_candidates(docs_frame(spark, rows)).select(F.explode("_cands").alias("c")).select("c.*")
    kinds = cands.groupBy("gen", *FEATURES).agg(F.min("y").alias("low"), F.max("y").alias("high")).collect()
    assert len(kinds) == 1 and (kinds[0].low, kinds[0].high) == (0, 1)


def test_compressed_addresses_and_dates(spark):
    """Short forms of addresses are found among many times of day; dates in parentheses are no telephone numbers."""
    rows = [(i, f"at 12:34:{i % 50 + 10} we met, (2023) 12 31 15 44 and std::vector a::b") for i in range(80)]
    rows += [(100, "host 2001:db8::1 is up"), (101, "from fe80::1ff:fe23:4567:890a, again"), (102, "12::34::56 1:2:3:4:5:6:7:8:9")]
    got = {r.doc_id: r.spans for r in find_pii(docs_frame(spark, rows)).collect()}
    assert got[100] == "ip:5:16" and got[101] == "ip:5:29" and got[102] == ""
    assert all(got[i] == "" for i in range(80))


def test_redaction(spark):
    rows = [(1, "mail a@b.co or 1.2.3.4!"), (2, None), (3, "none"), (4, "\U0001f600 a@b.co")]
    got = {r.doc_id: r for r in redact_documents(docs_frame(spark, rows)).collect()}
    assert [got[i].text for i in (1, 2, 3, 4)] == ["mail <EMAIL> or <IP>!", None, "none", "\U0001f600 <EMAIL>"]
    assert got[1].source == "s1" and redact_documents(docs_frame(spark, rows).limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = find_pii(spark.range(3).select(F.col("id").alias("doc_id"), F.lit("a@b.co").alias("text")))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()


def test_boosted_trees(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 4, (500, 3))
    y = ((x[:, 0] > 1) ^ (x[:, 2] == 0)).astype(float)
    model = boost(x, y, np.ones(500))
    score = margins(model, x)
    assert ((score > 0) == (y > 0)).mean() > 0.97
    rows = spark.createDataFrame([tuple(map(int, r)) for r in x[:50]], "a int, b int, c int")
    got = [r[0] for r in rows.select(as_column(model, [F.col(c) for c in "abc"])).collect()]
    assert got == pytest.approx(score[:50].tolist())
    assert threshold(np.array([3.0, 2.0, 1.0]), np.array([1.0, 1.0, 0.0]), np.ones(3), 0.9) == 2.0
    assert threshold(np.array([1.0]), np.array([0.0]), np.ones(1), 0.9) == float("inf")
