"""Keyset pages, cursors, bulk paging, rollups."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfrate.functions.text import decode_cursor, encode_cursor
from shelfrate.operators import catalog, rollup


def _products(spark, n=57):
    return spark.createDataFrame([(f"id{i:03d}", f"c{i % 3}", Decimal(i % 7) + Decimal("0.50"), f"name{i}")
                                  for i in range(n)],
                                 "id string, category_id string, effective_price decimal(12,2), name string")


def test_keyset_walk_covers_everything(spark):
    prods = _products(spark)
    seen, cursor = [], None
    for _ in range(10):
        page = catalog.keyset_page(prods, "effective_price", "asc", 20, cursor=cursor).collect()
        seen += [r["id"] for r in page]
        cursor = page[-1]["next_cursor"] if page else None
        if cursor is None:
            break
    expected = [r["id"] for r in prods.orderBy("effective_price", "id").collect()]
    assert seen == expected


def test_keyset_desc_and_name(spark):
    prods = _products(spark, 30)
    p1 = catalog.keyset_page(prods, "name", "desc", 10).collect()
    p2 = catalog.keyset_page(prods, "name", "desc", 10, cursor=p1[-1]["next_cursor"]).collect()
    names = [r["name"] for r in p1 + p2]
    assert names == sorted(names, reverse=True)[:20] or names == [r["name"] for r in
                                                                  prods.orderBy(F.col("name").desc(),
                                                                                F.col("id").desc()).limit(20).collect()]


def test_bad_cursor_gives_first_page(spark):
    prods = _products(spark, 30)
    first = [r["id"] for r in catalog.keyset_page(prods, limit=5).collect()]
    junk = [r["id"] for r in catalog.keyset_page(prods, limit=5, cursor="!!not-a-cursor").collect()]
    assert first == junk


def test_page_args(spark):
    with pytest.raises(ValueError):
        catalog.check_page_args(limit=101)
    with pytest.raises(ValueError):
        catalog.check_page_args(sort="price")


def test_cursor_roundtrip(spark):
    df = spark.createDataFrame([("75", "a1"), ("0.1", "b2")], "s string, i string")
    enc = df.select(encode_cursor(F.col("s"), F.col("i")).alias("c"))
    assert enc.first()["c"] == "eyJzIjoiNzUiLCJpIjoiYTEifQ"
    dec = enc.select(decode_cursor("c").alias("d")).collect()
    assert [(r["d"]["s"], r["d"]["i"]) for r in dec] == [("75", "a1"), ("0.1", "b2")]


def test_listing_pages_per_category(spark):
    prods = _products(spark)
    pages = catalog.listing_pages(prods, "effective_price", 5).collect()
    for cat in ("c0", "c1", "c2"):
        rows = sorted([r for r in pages if r["category_id"] == cat], key=lambda r: (r["effective_price"], r["id"]))
        assert [(r["page_no"], r["page_pos"]) for r in rows] == [(i // 5 + 1, i % 5 + 1) for i in range(len(rows))]


def test_histogram_and_counters(spark):
    ev = spark.createDataFrame([("GET", "/a", "200", Decimal("0.004")), ("GET", "/a", "200", Decimal("0.3")),
                                ("GET", "/a", "200", Decimal("7")), ("POST", "/b", "500", Decimal("1"))],
                               "method string, route string, status_code string, v decimal(12,4)")
    h = {(r["route"], r["le"]): r for r in rollup.histogram(ev, ["method", "route", "status_code"], "v").collect()}
    assert h[("/a", "0.005")]["bucket_count"] == 1
    assert h[("/a", "0.5")]["bucket_count"] == 2
    assert h[("/a", "+Inf")]["bucket_count"] == 3 and h[("/a", "+Inf")]["count"] == 3
    assert h[("/b", "1")]["bucket_count"] == 1
    reqs = spark.createDataFrame([("/metrics",), ("/health",), ("/ready",), ("/products",)], "path string")
    assert [r["path"] for r in rollup.request_log_filter(reqs).collect()] == ["/products"]
    c = {r["label"]: r["value"] for r in rollup.counter(
        spark.createDataFrame([("hit", 1), ("miss", 1), ("invalidate", 3)], "label string, w long"),
        ["label"], weight="w").collect()}
    assert c == {"hit": 1, "miss": 1, "invalidate": 3}
