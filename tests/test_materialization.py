"""Category apply / revert / cancel and PRODUCT-promotion conflict scenarios."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from admission_reference import admit_reference

from shelfrate.operators import admission, catalog, promote, rules

NOW = dt.datetime(2026, 1, 10)
PSCHEMA = ("id string, name string, discount_type string, discount_value decimal(12,2), scope string, "
           "target_product_id string, target_category_id string, starts_at timestamp, ends_at timestamp, "
           "status string, created_at timestamp")


def _products(spark, n, cat="cat-1", price="100.00"):
    return spark.createDataFrame(
        [(f"p{i:04d}", f"SKU-{i}", cat, Decimal(price), None, Decimal(price)) for i in range(n)],
        "id string, sku string, category_id string, base_price decimal(12,2), "
        "active_promotion_id string, effective_price decimal(12,2)")


def _promo(spark, pid, scope, dtype, value, target, status="ACTIVE", start=None, end=None, created=None):
    start = start or dt.datetime(2026, 1, 1)
    end = end or dt.datetime(2026, 2, 1)
    return spark.createDataFrame([(pid, pid, dtype, Decimal(value), scope,
                                   target if scope == "PRODUCT" else None,
                                   target if scope == "CATEGORY" else None,
                                   start, end, status, created or start)], PSCHEMA)


def test_apply_category_1000(spark):
    prods = _products(spark, 1000)
    promo = _promo(spark, "cat25", "CATEGORY", "PERCENTAGE", "25", "cat-1")
    snap, changes = promote.apply_category(prods, promo, promo, F.lit(NOW))
    prices = {r["effective_price"] for r in snap.collect()}
    assert prices == {Decimal("75.00")}
    assert changes.count() == 1000
    links = promote.category_links(prods, promo)
    assert links.count() == 1000
    keys = promote.invalidation_keys(changes).collect()
    assert len(keys) == 1000 and {r["group_index"] for r in keys} == {0}


def test_new_product_autojoins_live_category(spark):
    promo = _promo(spark, "fx15", "CATEGORY", "FIXED_AMOUNT", "15", "cat-1")
    newp = spark.createDataFrame([("n1", "NEW-1", "cat-1", Decimal("100.00"))],
                                 "id string, sku string, category_id string, base_price decimal(12,2)")
    rows, links = catalog.create_products(newp, promo, F.lit(NOW))
    r = rows.first()
    assert (r["effective_price"], r["active_promotion_id"]) == (Decimal("85.00"), "fx15")
    assert links.count() == 1


def test_apply_then_cancel_reverts(spark):
    prods = _products(spark, 50)
    promo = _promo(spark, "half", "CATEGORY", "PERCENTAGE", "50", "cat-1")
    snap, _ = promote.apply_category(prods, promo, promo, F.lit(NOW))
    assert {r["effective_price"] for r in snap.collect()} == {Decimal("50.00")}
    promos_after, reverted, changes = promote.cancel_category(snap.drop("changed"), promo,
                                                              promo.select("id"))
    got = reverted.collect()
    assert {r["effective_price"] for r in got} == {Decimal("100.00")}
    assert {r["active_promotion_id"] for r in got} == {None}
    assert promos_after.first()["status"] == "CANCELLED"
    assert changes.count() == 50


def test_outranked_product_is_skipped(spark):
    prods = spark.createDataFrame([("p1", "S1", "cat-1", Decimal("100.00"), "own", Decimal("90.00")),
                                   ("p2", "S2", "cat-1", Decimal("100.00"), None, Decimal("100.00"))],
                                  "id string, sku string, category_id string, base_price decimal(12,2), "
                                  "active_promotion_id string, effective_price decimal(12,2)")
    own = _promo(spark, "own", "PRODUCT", "PERCENTAGE", "10", "p1")
    cat = _promo(spark, "cat", "CATEGORY", "PERCENTAGE", "25", "cat-1")
    snap, _ = promote.apply_category(prods, own.unionByName(cat), cat, F.lit(NOW))
    got = {r["id"]: (r["active_promotion_id"], r["effective_price"]) for r in snap.collect()}
    assert got == {"p1": ("own", Decimal("90.00")), "p2": ("cat", Decimal("75.00"))}


def test_cancel_product_reevaluates(spark):
    prods = spark.createDataFrame([("p1", "cat-1", Decimal("100.00"), "a", Decimal("75.00"))],
                                  "id string, category_id string, base_price decimal(12,2), "
                                  "active_promotion_id string, effective_price decimal(12,2)")
    a = _promo(spark, "a", "PRODUCT", "PERCENTAGE", "25", "p1")
    out, changes = promote.cancel_product(prods, a, a.select("id"), F.lit(NOW))
    r = out.first()
    assert (r["active_promotion_id"], r["effective_price"]) == (None, Decimal("100.00"))
    c = _promo(spark, "c", "CATEGORY", "FIXED_AMOUNT", "10", "cat-1")
    out2, _ = promote.cancel_product(prods, a.unionByName(c), a.select("id"), F.lit(NOW))
    r2 = out2.first()
    assert (r2["active_promotion_id"], r2["effective_price"]) == ("c", Decimal("90.00"))


def _requests(spark, rows):
    return spark.createDataFrame(
        [(rid, scope, tp, tc, s, e, s, arr) for rid, scope, tp, tc, s, e, arr in rows],
        "id string, scope string, target_product_id string, target_category_id string, "
        "starts_at timestamp, ends_at timestamp, created_at timestamp, arrival long")


def test_conflicts_and_serialized_admission(spark):
    prods = spark.createDataFrame([("p1", "cat-1")], "id string, category_id string")
    empty = spark.createDataFrame([], PSCHEMA)
    d1, d2 = dt.datetime(2026, 1, 1), dt.datetime(2026, 2, 1)
    # two simultaneous overlapping requests on one product: exactly one accepted
    req = _requests(spark, [("r1", "PRODUCT", "p1", None, d1, d2, 1), ("r2", "PRODUCT", "p1", None, d1, d2, 2)])
    got = {r["id"]: r for r in admission.admit(req, empty, prods).collect()}
    assert got["r1"]["admitted"] and not got["r2"]["admitted"]
    assert got["r2"]["reason"] == "EXISTING_PRODUCT_PROMOTION" and got["r2"]["conflicting_promotion_id"] == "r1"
    # second overlapping category promotion -> EXISTING_CATEGORY_PROMOTION
    req = _requests(spark, [("c1", "CATEGORY", None, "cat-1", d1, d2, 1),
                            ("c2", "CATEGORY", None, "cat-1", d1, d2, 2)])
    got = {r["id"]: r for r in admission.admit(req, empty, prods).collect()}
    assert got["c1"]["admitted"] and got["c2"]["reason"] == "EXISTING_CATEGORY_PROMOTION"
    # after cancelling the existing one, a new request is accepted
    existing = _promo(spark, "old", "PRODUCT", "PERCENTAGE", "25", "p1", status="CANCELLED")
    req = _requests(spark, [("r3", "PRODUCT", "p1", None, d1, d2, 1)])
    assert admission.admit(req, existing, prods).first()["admitted"]
    existing = _promo(spark, "old", "PRODUCT", "PERCENTAGE", "25", "p1")
    r = admission.admit(req, existing, prods).first()
    assert not r["admitted"] and r["conflicting_promotion_id"] == "old"


def test_admission_matches_brute_force(spark):
    import random
    rnd = random.Random(7)
    base = dt.datetime(2026, 1, 1)
    cats = {f"p{i}": f"c{i % 3}" for i in range(6)}
    reqs, existing = [], []
    for i in range(400):
        scope = "CATEGORY" if rnd.random() < 0.25 else "PRODUCT"
        s = base + dt.timedelta(days=rnd.randint(0, 200))
        e = s + dt.timedelta(days=rnd.randint(1, 40))
        tp = rnd.choice(list(cats)) if scope == "PRODUCT" else None
        tc = f"c{rnd.randint(0, 2)}" if scope == "CATEGORY" else None
        item = {"id": f"r{i:03d}", "scope": scope, "target_product_id": tp, "target_category_id": tc,
                "starts_at": s, "ends_at": e, "arrival": rnd.randint(0, 50)}
        if i < 40:
            item["status"] = rnd.choice(["ACTIVE", "SCHEDULED", "CANCELLED"])
            existing.append(item)
        else:
            reqs.append(item)
    expected = admit_reference(reqs, existing, cats)
    prods = spark.createDataFrame(list(cats.items()), "id string, category_id string")
    rq = spark.createDataFrame([(r["id"], r["scope"], r["target_product_id"], r["target_category_id"],
                                 r["starts_at"], r["ends_at"], r["starts_at"], r["arrival"]) for r in reqs],
                               "id string, scope string, target_product_id string, target_category_id string, "
                               "starts_at timestamp, ends_at timestamp, created_at timestamp, arrival long")
    ex = spark.createDataFrame([(r["id"], r["scope"], r["target_product_id"], r["target_category_id"],
                                 r["starts_at"], r["ends_at"], r["starts_at"], r["status"]) for r in existing],
                               "id string, scope string, target_product_id string, target_category_id string, "
                               "starts_at timestamp, ends_at timestamp, created_at timestamp, status string")
    got = {r["id"]: r["admitted"] for r in admission.admit(rq, ex, prods).collect()}
    assert got == expected
    # pandas fold path (forced) gives the same answer
    old = admission.CATALYST_FOLD_MAX
    admission.CATALYST_FOLD_MAX = 1
    try:
        got2 = {r["id"]: r["admitted"] for r in admission.admit(rq, ex, prods).collect()}
    finally:
        admission.CATALYST_FOLD_MAX = old
    assert got2 == expected


def test_create_promotions_batch(spark):
    prods = spark.createDataFrame([("p1", "cat-1", Decimal("100.00"), None, Decimal("100.00")),
                                   ("p2", "cat-1", Decimal("100.00"), None, Decimal("100.00"))],
                                  "id string, category_id string, base_price decimal(12,2), "
                                  "active_promotion_id string, effective_price decimal(12,2)")
    existing = spark.createDataFrame([], PSCHEMA)
    d1, d2, future = dt.datetime(2026, 1, 1), dt.datetime(2026, 2, 1), dt.datetime(2026, 3, 1)
    req = spark.createDataFrame(
        [("a", "a", "PERCENTAGE", Decimal("25"), "PRODUCT", "p1", None, d1, d2, d1, 1),
         ("b", "b", "PERCENTAGE", Decimal("50"), "PRODUCT", "p1", None, d1, d2, d1, 2),
         ("c", "c", "FIXED_AMOUNT", Decimal("10"), "CATEGORY", None, "cat-1", d1, d2, d1, 3),
         ("s", "s", "PERCENTAGE", Decimal("10"), "PRODUCT", "p2", None, future, future + dt.timedelta(days=5),
          d1, 4)],
        "id string, name string, discount_type string, discount_value decimal(12,2), scope string, "
        "target_product_id string, target_category_id string, starts_at timestamp, ends_at timestamp, "
        "created_at timestamp, arrival long")
    out = promote.create_promotions(req, existing, prods, F.lit(NOW))
    dec = {r["id"]: r["admitted"] for r in out["decisions"].collect()}
    # c is CATEGORY: checked against CATEGORY promotions only (Q1), so admitted
    assert dec == {"a": True, "b": False, "c": True, "s": True}
    snap = {r["id"]: (r["active_promotion_id"], r["effective_price"]) for r in out["products"].collect()}
    assert snap["p1"] == ("a", Decimal("75.00"))      # live PRODUCT promotion outranks c
    assert snap["p2"] == ("c", Decimal("90.00"))
    status = {r["id"]: r["status"] for r in out["promotions"].collect()}
    assert status["s"] == "SCHEDULED" and status["a"] == "ACTIVE"
    links = {(r["product_id"], r["promotion_id"]) for r in out["links"].collect()}
    assert ("p1", "a") in links and ("p2", "s") in links


def test_refused_requests_create_nothing(spark):
    """Unknown targets, ended windows and malformed requests come back with their reason."""
    stamp = dt.datetime(2020, 1, 1)
    prods = spark.createDataFrame([("p1", "cat-1", Decimal("100.00"), None, Decimal("100.00"), stamp, stamp)],
                                  "id string, category_id string, base_price decimal(12,2), active_promotion_id string, "
                                  "effective_price decimal(12,2), effective_price_updated_at timestamp, updated_at timestamp")
    d1, d2, old = dt.datetime(2026, 1, 1), dt.datetime(2026, 2, 1), dt.datetime(2025, 2, 1)
    req = spark.createDataFrame(
        [("nope", "n", "PERCENTAGE", Decimal("25"), "PRODUCT", "NOPE", None, d1, d2, d1, 1),
         ("nocat", "n", "PERCENTAGE", Decimal("25"), "CATEGORY", None, "cat-9", d1, d2, d1, 2),
         ("late", "n", "PERCENTAGE", Decimal("25"), "PRODUCT", "p1", None, dt.datetime(2025, 1, 1), old, d1, 3),
         ("empty", "n", "PERCENTAGE", Decimal("25"), "PRODUCT", "p1", None, d2, d2, d1, 4),
         ("both", "n", "PERCENTAGE", Decimal("25"), "PRODUCT", "p1", "cat-1", d1, d2, d1, 5),
         ("good", "n", "PERCENTAGE", Decimal("25"), "PRODUCT", "p1", None, d1, d2, d1, 6)],
        "id string, name string, discount_type string, discount_value decimal(12,2), scope string, "
        "target_product_id string, target_category_id string, starts_at timestamp, ends_at timestamp, "
        "created_at timestamp, arrival long")
    out = promote.create_promotions(req, spark.createDataFrame([], PSCHEMA), prods, F.lit(NOW))
    dec = {r["id"]: (r["admitted"], r["reason"]) for r in out["decisions"].collect()}
    assert dec["good"] == (True, None) and dec["nope"] == (False, "Product NOPE not found")
    assert dec["nocat"] == (False, "Category cat-9 not found") and dec["late"] == (False, "endsAt must be in the future")
    assert dec["empty"][1].startswith("endsAt: ") and dec["both"][1].startswith("scope: ")
    assert [r["id"] for r in out["promotions"].collect()] == ["good"]
    p1 = out["products"].first()
    assert p1["effective_price"] == Decimal("75.00") and p1["updated_at"] == p1["effective_price_updated_at"] != stamp
    assert [(r["promotion_id"], r["applied_at"] is not None) for r in out["links"].collect()] == [("good", True)]


def test_cancel_refusals(spark):
    promos = spark.createDataFrame([("a", "ACTIVE"), ("c", "CANCELLED"), ("e", "EXPIRED")], "id string, status string")
    ids = spark.createDataFrame([("a",), ("c",), ("e",), ("x",)], "id string")
    got = {r["id"]: r["reason"] for r in promote.cancel_refusals(promos, ids).collect()}
    assert got == {"c": "Promotion is already cancelled", "x": "Promotion x not found"}
