"""Distributed scans (components, overlap sweep, global numbering) against
brute force, including a downstream union (partition ids shift there)."""

import datetime as dt
import random
from collections import defaultdict

from pyspark.sql import functions as F

from shelfrate.plans.ordering import global_row_number, interval_components
from shelfrate.plans.ranges import overlap_join, overlaps_any

BASE = dt.datetime(2026, 1, 1)
EPOCH = dt.datetime(1970, 1, 1)


def _windows(rnd, n, off):
    out = []
    for i in range(n):
        k = "hot" if rnd.random() < 0.5 else f"k{rnd.randint(0, 20)}"
        s = BASE + dt.timedelta(hours=rnd.randint(0, 8000))
        out.append((i + off, k, s, s + dt.timedelta(hours=rnd.randint(1, 40))))
    return out


def _us(t):
    return int((t - EPOCH).total_seconds() * 1_000_000)


def test_interval_components_with_hot_key(spark):
    rows = _windows(random.Random(3), 1500, 0)
    df = spark.createDataFrame(rows, "id long, k string, s timestamp, e timestamp")
    comp = interval_components(df, "k", "s", "e", "id", num_partitions=7)
    other = spark.createDataFrame([(-1, "x", BASE, BASE, "none")], "id long, k string, s timestamp, "
                                                                     "e timestamp, __comp string")
    got = {r["id"]: r["__comp"] for r in other.unionByName(comp).collect() if r["id"] >= 0}
    byk = defaultdict(list)
    for r in rows:
        byk[r[1]].append(r)
    exp = {}
    for lst in byk.values():
        lst.sort(key=lambda r: (r[2], r[3], r[0]))
        mx = mk = None
        for r in lst:
            if mx is None or _us(r[2]) >= mx:
                mk = f"{_us(r[2])}:{r[0]}"
            mx = _us(r[3]) if mx is None else max(mx, _us(r[3]))
            exp[r[0]] = mk
    assert got == exp


def test_overlaps_any_and_overlap_join(spark):
    rnd = random.Random(5)
    c, b = _windows(rnd, 1200, 0), _windows(rnd, 900, 10_000)
    cdf = spark.createDataFrame(c, "id long, k string, s timestamp, e timestamp")
    bdf = spark.createDataFrame(b, "bid long, bk string, bs timestamp, be timestamp")
    exp = {x[0] for x in c if any(y[1] == x[1] and y[2] < x[3] and x[2] < y[3] for y in b)}
    hits = overlaps_any(cdf, bdf, "k", "bk", "s", "e", "bs", "be", num_partitions=6)
    extra = spark.createDataFrame([(-5,)], "id long")
    assert {r["id"] for r in extra.unionByName(hits).collect()} - {-5} == exp
    pairs = overlap_join(cdf, bdf, "k", "bk", "s", "e", "bs", "be")
    exp_pairs = {(x[0], y[0]) for x in c for y in b if y[1] == x[1] and y[2] < x[3] and x[2] < y[3]}
    assert {(r["id"], r["bid"]) for r in pairs.collect()} == exp_pairs


def test_global_row_number(spark):
    df = spark.range(0, 997).select(((F.col("id") * 7919) % 997).alias("v"))
    got = global_row_number(df, [F.col("v").asc()], num_partitions=5).collect()
    assert sorted((r["v"], r["rn"]) for r in got) == [(v, v + 1) for v in range(997)]


def test_join_small_fallbacks(spark):
    from shelfrate.plans.joins import join_small
    big = spark.createDataFrame([(f"p{i}", "hot" if i % 3 else None, "c" + str(i % 2)) for i in range(60)],
                                "id string, active string, cat string")
    small = spark.createDataFrame([("hot", 1), ("x", 2)], "sid string, v int")
    cats = spark.createDataFrame([("c0", 10), ("c1", 11)], "ck string, w int")
    exp = sorted((f"p{i}", 1 if i % 3 else None) for i in range(60))
    for max_rows in (100, 0):  # broadcast path, then null-split shuffle path
        out = join_small(big, small, big["active"] == small["sid"], "left", max_rows=max_rows, big_key="active")
        assert sorted((r["id"], r["v"]) for r in out.collect()) == exp
        salted = join_small(big, cats, big["cat"] == cats["ck"], "left", max_rows=max_rows, salt_buckets=8,
                            salt_source=F.col("id"), big_key="cat", small_key="ck")
        assert sorted((r["id"], r["w"]) for r in salted.collect()) == \
            sorted((f"p{i}", 10 + i % 2) for i in range(60))
