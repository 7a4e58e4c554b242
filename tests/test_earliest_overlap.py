"""Dyadic covers, the pair join over them, and the first overlap without pairs, against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shelfrate.operators import admission
from shelfrate.plans import ranges
from shelfrate.plans.dyadic import cover, nodes_of
from shelfrate.plans.ranges import cover_rows, earliest_overlap, overlap_join

BASE = dt.datetime(2026, 1, 1)
OPEN = (dt.datetime(1, 1, 1), dt.datetime(9999, 12, 31))


@pytest.mark.parametrize("first,last", [(0, 0), (1, 6), (5, 4), (-7, 9), (-8, -1), (3, 1000), (0, 1023), (1, 2**40)])
def test_cover_is_the_range(spark, first, last):
    df = spark.createDataFrame([(first, last)], "a long, b long")
    nodes = df.select(cover(F.col("a"), F.col("b")).alias("c")).first().c
    spans = sorted((n.node << n.level, ((n.node + 1) << n.level) - 1) for n in nodes)
    assert len(nodes) <= 2 * max(1, (last - first + 1).bit_length())
    assert all(y + 1 == x for (_, y), (x, _) in zip(spans, spans[1:]))
    assert (spans == []) if last < first else (spans[0][0], spans[-1][1]) == (first, last)
    if last >= first:
        for p in {first, last, (first + last) // 2}:
            row = spark.createDataFrame([(p,)], "p long").select(nodes_of(F.col("p"), list(range(48))).alias("n")).first()
            assert len({(n.level, n.node) for n in row.n} & {(n.level, n.node) for n in nodes}) == 1


def _windows(rnd, n, off, dense):
    out = []
    for i in range(n):
        k = "hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", "c", None])
        s = BASE + dt.timedelta(hours=rnd.randint(0, 300 if dense else 9000))
        e = s + dt.timedelta(hours=rnd.choice([1, 1, 5, 40, 900, 0, -3]))
        out.append((i + off, k, s, e))
    out += [(off + n, "hot", *OPEN), (off + n + 1, "a", OPEN[0], BASE), (off + n + 2, "b", BASE, OPEN[1]),
            (off + n + 3, "hot", None, BASE), (off + n + 4, "hot", BASE, BASE), (off + n + 5, "hot", BASE, BASE + dt.timedelta(1))]
    return out


def _meet(x, y):
    return (x[1] == y[1] and None not in (x[1], x[2], y[2]) and x[2] < y[3] and y[2] < x[3])


@pytest.mark.parametrize("dense", [True, False])
def test_against_all_pairs(spark, dense):
    rnd = random.Random(11)
    c, b = _windows(rnd, 260, 0, dense), _windows(rnd, 240, 10_000, dense)
    rank = {y[0]: rnd.randrange(60) for y in b}
    cdf = spark.createDataFrame(c, "id long, key string, start timestamp, end timestamp")
    bdf = spark.createDataFrame([(*y, rank[y[0]]) for y in b], "bid long, bkey string, bs timestamp, be timestamp, rank int")
    pairs = overlap_join(cdf, bdf, "key", "bkey", "start", "end", "bs", "be").select("id", "bid").collect()
    want = [(x[0], y[0]) for x in c for y in b if _meet(x, y)]
    assert sorted(tuple(p) for p in pairs) == sorted(want)  # each pair once
    got = earliest_overlap(cdf, bdf.selectExpr("bid", "bkey AS key", "bs AS start", "be AS end", "rank"),
                           {"low": F.struct("rank", "bid"), "even": F.when(F.col("bid") % 2 == 0, F.col("bid"))})
    first = {}
    for i, j in want:
        low, even = first.get(i, ((99, 0), None))
        first[i] = (min(low, (rank[j], j)), min([x for x in (even, j if j % 2 == 0 else None) if x is not None], default=None))
    assert {r.id: (tuple(r.low), r.even) for r in got.collect()} == first


def test_a_window_is_few_rows(spark):
    rows = [(1, *OPEN), (2, dt.datetime(1998, 1, 1), dt.datetime(9998, 1, 1)), (3, BASE, BASE + dt.timedelta(hours=1)),
            (4, dt.datetime(1900, 5, 5), dt.datetime(2500, 3, 2))]
    df = spark.createDataFrame(rows, "id long, s timestamp, e timestamp")
    n = {r.id: r["count"] for r in cover_rows(df, "s", "e").groupBy("id").count().collect()}
    assert max(n.values()) <= 42 and n[3] == 1  # and 21 rows at most for a window's start


def test_dense_target_makes_no_pairs(spark, monkeypatch):
    """10 000 windows of one target that all overlap: no operator's output exceeds some rows for each window."""
    n = 10_000
    rows = spark.range(n).selectExpr(
        "id", "'hot' AS key", "timestamp_micros(1700000000000000 + id * 1000000) AS start",
        "timestamp_micros(1800000000000000 - ((id * 7919) % 10007) * 1000000) AS end", "(id * 31) % 9973 AS rank")
    joins = []
    kind = type(rows)
    join = kind.join
    monkeypatch.setattr(kind, "join", lambda *args, **kw: joins.append(join(*args, **kw)) or joins[-1])
    got = earliest_overlap(rows.select("id", "key", "start", "end"), rows, {"low": F.struct("rank", "id")}).collect()
    assert len(got) == n and {tuple(r.low) for r in got} == {(0, 0)}
    assert joins and max(j.count() for j in joins) <= 32 * n


def test_first_blocker_takes_orders_and_standing_blockers(spark):
    """Blockers without an order value always precede; of both kinds the older created_at is reported."""
    rnd = random.Random(3)
    prods = spark.createDataFrame([("p1", "c1"), ("p2", "c1")], "id string, category_id string")
    rows = []
    for i in range(160):
        s = BASE + dt.timedelta(hours=rnd.randint(0, 500))
        scope = rnd.choice(["PRODUCT", "CATEGORY"])
        order = rnd.choice([None, rnd.randrange(200)])
        created = None if rnd.random() < 0.1 else BASE + dt.timedelta(minutes=order if order is not None else rnd.randrange(200))
        rows.append((f"r{i:03}", scope, rnd.choice(["p1", "p2"]) if scope == "PRODUCT" else None,
                     "c1" if scope == "CATEGORY" else None, s, s + dt.timedelta(hours=rnd.randint(1, 60)), created, order))
    df = spark.createDataFrame(rows, "id string, scope string, target_product_id string, target_category_id string, "
                                     "starts_at timestamp, ends_at timestamp, created_at timestamp, ord int")
    cand = df.filter("ord IS NOT NULL")
    got = {r.id: (r.reason, r.conflicting_promotion_id)
           for r in admission.first_blockers(cand, df, prods, "ord").collect()}
    want = {}
    old = lambda x: (x[6] is None, x[6] or BASE, x[0])
    for c in rows:
        if c[7] is None:
            continue
        hits = [b for b in rows if b[4] < c[5] and c[4] < b[5] and (b[7] is None or (b[7], b[0]) < (c[7], c[0])) and (
            (b[1] == "CATEGORY") if c[1] == "CATEGORY" else (b[1] == "CATEGORY" or b[2] == c[2]))]
        ordered = sorted((b for b in hits if b[7] is not None), key=lambda b: (b[7], b[0]))[:1]
        standing = sorted((b for b in hits if b[7] is None), key=old)[:1]
        if ordered + standing:
            b = min(ordered + standing, key=old)
            want[c[0]] = (f"EXISTING_{b[1]}_PROMOTION", b[0])
    assert got == want


@pytest.mark.parametrize("block", [4, 16, 1 << 14])
def test_windows_over_many_blocks(spark, monkeypatch, block):
    """Windows that lie in one block, reach into the next, or hold many; a window is some rows, however many it meets."""
    monkeypatch.setattr(ranges, "BLOCK", block)
    rnd = random.Random(block)
    c, b = _windows(rnd, 150, 0, True), _windows(rnd, 140, 10_000, True)
    rank = {y[0]: rnd.randrange(30) for y in b}
    cdf = spark.createDataFrame(c, "id long, key string, start timestamp, end timestamp")
    bdf = spark.createDataFrame([(*y, rank[y[0]]) for y in b], "bid long, key string, start timestamp, end timestamp, rank int")
    got = earliest_overlap(cdf, bdf, {"low": F.struct("rank", "bid"), "none": F.when(F.col("bid") < 0, F.col("bid"))}).collect()
    want = {x[0]: min((rank[y[0]], y[0]) for y in b if _meet(x, y)) for x in c if any(_meet(x, y) for y in b)}
    assert {r.id: (tuple(r.low), r.none) for r in got} == {i: (w, None) for i, w in want.items()}


def test_a_window_is_few_rows_in_blocks(spark, monkeypatch):
    n, joins = 5000, []
    rows = spark.range(n).selectExpr(
        "id", "'hot' AS key", "timestamp_micros(1700000000000000 + id * 1000000) AS start",
        "timestamp_micros(1800000000000000 + ((id * 7919) % 10007) * 1000000) AS end", "id AS rank")
    join, kind = type(rows).join, type(rows)
    monkeypatch.setattr(kind, "join", lambda *args, **kw: joins.append(join(*args, **kw)) or joins[-1])
    got = earliest_overlap(rows.select("id", "key", "start", "end"), rows, {"low": F.col("rank")}).collect()
    assert len(got) == n and {r.low for r in got} == {0}
    assert max(j.count() for j in joins) <= 4 * n  # the starts and ends of candidates and blockers
