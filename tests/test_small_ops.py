"""Small operators: applicability, lookups, views, cancel rule, cache keys."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from shelfrate.functions.text import list_namespace_key, product_cache_key, resource_of
from shelfrate.operators import catalog, promote, quality, rules

T = dt.datetime(2026, 1, 5)


def _promos(spark):
    return spark.createDataFrame(
        [("a", "PRODUCT", "p1", None, "ACTIVE", dt.datetime(2026, 1, 1), dt.datetime(2026, 2, 1)),
         ("b", "CATEGORY", None, "c1", "SCHEDULED", dt.datetime(2026, 1, 1), dt.datetime(2026, 2, 1)),
         ("x", "PRODUCT", "p1", None, "CANCELLED", dt.datetime(2026, 1, 1), dt.datetime(2026, 2, 1))],
        "id string, scope string, target_product_id string, target_category_id string, status string, "
        "starts_at timestamp, ends_at timestamp")


def test_applicable_promotions_two_equi_joins(spark):
    prods = spark.createDataFrame([("p1", "c1"), ("p2", "c1"), ("p3", "c2")], "id string, category_id string")
    pairs = rules.applicable_promotions(prods, _promos(spark))
    got = sorted((r["product_id"], r["id"]) for r in pairs.collect())
    assert got == [("p1", "a"), ("p1", "b"), ("p2", "b")]
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan


def test_lookups_and_holders(spark):
    prods = spark.createDataFrame([("p1", "c1", "a"), ("p2", "c1", "b"), ("p3", "c2", None)],
                                  "id string, category_id string, active_promotion_id string")
    assert catalog.find_by_id(prods, "p2").first()["id"] == "p2"
    keys = spark.createDataFrame([("p1",), ("p3",), ("p3",)], "k string")
    assert sorted(r["id"] for r in catalog.find_by_ids(prods, keys).collect()) == ["p1", "p3"]
    holders = promote.outranking_product_holders(prods, _promos(spark), F.lit(T))
    assert [r["id"] for r in holders.collect()] == ["p1"]


def test_views_and_rules(spark):
    b = spark.createDataFrame([("b1", "acme", "f.csv", "COMPLETED", 4, 4, 0, T, None)],
                              "id string, vendor_id string, source_file string, status string, total_rows int, "
                              "processed_rows int, failed_rows int, started_at timestamp, finished_at timestamp")
    v = catalog.batch_view(b).first()
    assert v["started_at"] == "2026-01-05T00:00:00.000Z" and v["finished_at"] is None
    c = spark.createDataFrame([("c1", "Shoes", T, T)], "id string, name string, created_at timestamp, "
                                                       "updated_at timestamp")
    assert catalog.category_view(c).first()["created_at"] == "2026-01-05T00:00:00.000Z"
    st = spark.createDataFrame([("CANCELLED",), ("EXPIRED",), ("ACTIVE",)], "status string")
    assert [r[0] for r in st.select(quality.cancel_errors()).collect()] == \
        ["Promotion is already cancelled", None, None]
    k = spark.createDataFrame([("42", None)], "id string, cat string").select(
        product_cache_key("id").alias("pk"), list_namespace_key("cat").alias("lk"))
    r = k.first()
    assert (r["pk"], r["lk"]) == ("product:42", "products:list:cat=all")
    assert spark.createDataFrame([("product:1",), ("products:list:cat=all",)], "k string").select(
        resource_of("k")).collect()[1][0] == "other"


def test_create_and_patch_validation(spark):
    df = spark.createDataFrame([("S", "N", "c1", "10.5", 1), ("", "N", None, "1.234", -1)],
                               "sku string, name string, category_id string, base_price string, "
                               "stock_quantity int")
    errs = [r[0] for r in df.select(quality.product_create_errors()).collect()]
    assert errs[0] is None
    assert errs[1] == ("sku: String must contain at least 1 character(s); categoryId: Required; "
                       "basePrice: expected a decimal with up to 2 fractional digits; "
                       "stockQuantity: Number must be greater than or equal to 0")
    empty = spark.createDataFrame([(None, None, None)], "name string, base_price string, stock_quantity int")
    assert empty.select(quality.product_patch_errors()).first()[0] == "at least one field must be provided"


def test_update_reprices_under_held_promotion(spark):
    prods = spark.createDataFrame([("p1", "n", Decimal("100.00"), 1, "a", Decimal("75.00"))],
                                  "id string, name string, base_price decimal(12,2), stock_quantity int, "
                                  "active_promotion_id string, effective_price decimal(12,2)")
    promos = spark.createDataFrame([("a", "PERCENTAGE", Decimal("25"))],
                                   "id string, discount_type string, discount_value decimal(12,2)")
    patch = spark.createDataFrame([("p1", None, Decimal("200.00"), None)],
                                  "id string, name string, base_price decimal(12,2), stock_quantity int")
    r = catalog.update_products(prods, patch, promos).first()
    assert (r["base_price"], r["effective_price"], r["name"], r["stock_quantity"]) == \
        (Decimal("200.00"), Decimal("150.00"), "n", 1)


def test_iso_text_is_utc_for_aware_timestamps(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        df = spark.sql("SELECT TIMESTAMP'2026-01-05 10:30:00.123' AS created_at, "
                       "TIMESTAMP_NTZ'2026-01-05 10:30:00.123' AS updated_at, 'c' AS id, 'n' AS name")
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        r = catalog.category_view(df).first()
        assert r["created_at"] == "2026-01-05T10:30:00.123Z"
        assert r["updated_at"] == "2026-01-05T10:30:00.123Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
