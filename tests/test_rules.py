"""Golden rows of the promotion rules (liveness, overlap, winner, conflict)."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfrate.operators import admission, rules

T0, T1, T2, T3 = (dt.datetime(2026, 1, d) for d in (1, 2, 3, 4))
SCHEMA = ("id string, scope string, status string, starts_at timestamp, ends_at timestamp, "
          "created_at timestamp, target_product_id string, target_category_id string, "
          "discount_type string, discount_value decimal(12,2)")


def promo(spark, rows):
    full = [(r["id"], r.get("scope", "PRODUCT"), r.get("status", "ACTIVE"), r.get("s", T1), r.get("e", T2),
             r.get("c"), r.get("tp", "p1") if r.get("scope", "PRODUCT") == "PRODUCT" else None,
             r.get("tc", "c1") if r.get("scope") == "CATEGORY" else None, "PERCENTAGE", Decimal(10))
            for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def at(t):
    return F.lit(t).cast("timestamp")


def test_live(spark):
    df = promo(spark, [{"id": "a"}])
    got = [df.select(rules.is_live(at(t))).first()[0] for t in (T1, T2, T0)]
    assert got == [True, False, False]
    df2 = promo(spark, [{"id": "c", "status": "CANCELLED"}, {"id": "x", "status": "EXPIRED"},
                        {"id": "s", "status": "SCHEDULED"}])
    assert [r[0] for r in df2.select(rules.is_live(at(T1))).collect()] == [False, False, True]


@pytest.mark.parametrize("a,b,expected", [((T0, T3), (T1, T2), True), ((T0, T1), (T1, T2), False),
                                          ((T0, T2), (T1, T3), True), ((T0, T1), (T2, T3), False)])
def test_overlap(spark, a, b, expected):
    df = spark.createDataFrame([(a[0], a[1], b[0], b[1])], "as_ timestamp, ae timestamp, bs timestamp, be timestamp")
    assert df.select(rules.windows_overlap("as_", "ae", "bs", "be")).first()[0] is expected


def _winner(spark, rows):
    products = spark.createDataFrame([("p1", "c1", Decimal(100))], "id string, category_id string, base_price decimal(12,2)")
    w = rules.winners_as_of(products, promo(spark, rows), at(T1))
    return w.select("winner_id").first()[0]


def test_winner(spark):
    assert _winner(spark, [{"id": "x", "status": "CANCELLED"}]) is None
    assert _winner(spark, [{"id": "prod", "c": T0}, {"id": "cat", "scope": "CATEGORY", "c": T1}]) == "prod"
    assert _winner(spark, [{"id": "cat", "scope": "CATEGORY"}]) == "cat"
    assert _winner(spark, [{"id": "old", "c": T0}, {"id": "new", "c": T1}]) == "new"
    assert _winner(spark, [{"id": "new", "c": T1}, {"id": "old", "c": T0}]) == "new"


def _conflict(spark, existing, cand_scope, s, e):
    products = spark.createDataFrame([("p1", "c1")], "id string, category_id string")
    ex = promo(spark, existing) if existing else spark.createDataFrame([], SCHEMA)
    cand = spark.createDataFrame([("new", cand_scope, s, e, T3, "p1" if cand_scope == "PRODUCT" else None,
                                   "c1" if cand_scope == "CATEGORY" else None)],
                                 "id string, scope string, starts_at timestamp, ends_at timestamp, "
                                 "created_at timestamp, target_product_id string, target_category_id string")
    r = admission.first_blockers(cand.withColumn("ord", F.lit(1)),
                                 ex.withColumn("ord", F.lit(None).cast("int")), products, "ord").collect()
    return r[0]["reason"] if r else None


def test_conflict(spark):
    assert _conflict(spark, [], "PRODUCT", T1, T3) is None
    assert _conflict(spark, [{"id": "e", "s": T1, "e": T3, "c": T0}], "PRODUCT", T2, T3) == \
        "EXISTING_PRODUCT_PROMOTION"
    assert _conflict(spark, [{"id": "e", "scope": "CATEGORY", "s": T1, "e": T3, "c": T0}], "PRODUCT", T2, T3) == \
        "EXISTING_CATEGORY_PROMOTION"
    assert _conflict(spark, [{"id": "c", "status": "CANCELLED", "s": T1, "e": T3, "c": T0},
                             {"id": "x", "status": "EXPIRED", "s": T1, "e": T3, "c": T0}],
                     "PRODUCT", T2, T3) is None
    assert _conflict(spark, [{"id": "e", "s": T1, "e": T2, "c": T0}], "PRODUCT", T2, T3) is None  # back to back
    # Q1: a CATEGORY request is not blocked by a PRODUCT promotion
    assert _conflict(spark, [{"id": "e", "s": T1, "e": T3, "c": T0}], "CATEGORY", T2, T3) is None


def test_inverted_candidate_is_invalid(spark):
    from shelfrate.operators import quality
    df = spark.createDataFrame([("n", "PERCENTAGE", "10", "PRODUCT", "p1", None, T2, T1)],
                               "name string, discount_type string, discount_value string, scope string, "
                               "target_product_id string, target_category_id string, starts_at timestamp, "
                               "ends_at timestamp")
    assert "endsAt: endsAt must be after startsAt" in df.select(quality.promotion_request_errors()).first()[0]
