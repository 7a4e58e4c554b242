"""Queries over products x promotions: prices, winners, liveness, conflicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfrate.operators import rules
from shelfrate.plans.catalog import iso, iso_sql, register
from shelfrate.plans.sqltext import (AS_OF_SQL, PRODUCTS_CTE, PROMOTIONS_CTE, WINNER_CTES,
                                     ctes, live, price_sql)
from shelfrate.sources import driver_tables as dt

PRICE_COLS = ["id", "sku", "name", "category_id", "base_price", "stock_quantity",
              "winner_id", "winner_scope", "discount_type", "discount_value", "effective_price"]


@register("effective_prices_as_of", ctes(PRODUCTS_CTE, PROMOTIONS_CTE, WINNER_CTES)
          + "SELECT " + ", ".join(PRICE_COLS) + " FROM state")
def effective_prices_as_of(spark, sf_dir):
    """Every product with its winner and price at the instant."""
    out = rules.effective_prices_as_of(dt.products(spark, sf_dir), dt.promotions(spark, sf_dir),
                                       dt.as_of_lit())
    return out.select(*PRICE_COLS)


def _state(spark, sf_dir):
    """Product snapshot at the instant: active promotion = winner."""
    s = rules.effective_prices_as_of(dt.products(spark, sf_dir), dt.promotions(spark, sf_dir),
                                     dt.as_of_lit())
    return s.withColumn("active_promotion_id", F.col("winner_id"))


_PF = ctes(PRODUCTS_CTE, PROMOTIONS_CTE)


@register("price_percentage_fixed", _PF + f"""
SELECT pr.id AS promotion_id, p.id AS product_id, p.base_price, pr.discount_type, pr.discount_value,
       {price_sql('p.base_price', 'pr.discount_type', 'pr.discount_value')} AS effective_price
FROM promotions pr JOIN products p ON p.id = pr.target_product_id
WHERE pr.scope = 'PRODUCT'""")
def price_percentage_fixed(spark, sf_dir):
    """Price of every PRODUCT promotion's target under it."""
    from shelfrate.functions.money import effective_price
    p = dt.products(spark, sf_dir)
    pr = dt.promotions(spark, sf_dir).filter(F.col("scope") == "PRODUCT")
    j = pr.join(p, pr["target_product_id"] == p["id"], "inner")
    return j.select(pr["id"].alias("promotion_id"), p["id"].alias("product_id"), "base_price",
                    "discount_type", "discount_value",
                    effective_price("base_price", "discount_type", "discount_value").alias("effective_price"))


@register("live_promotions", ctes(PROMOTIONS_CTE) + f"""
SELECT id, scope, status, target_product_id, target_category_id,
       {iso_sql('starts_at')} AS starts_at, {iso_sql('ends_at')} AS ends_at
FROM promotions WHERE {live()}""")
def live_promotions(spark, sf_dir):
    """promotions live at the instant."""
    pr = dt.promotions(spark, sf_dir).filter(rules.is_live(dt.as_of_lit()))
    return pr.select("id", "scope", "status", "target_product_id", "target_category_id",
                     iso("starts_at").alias("starts_at"), iso("ends_at").alias("ends_at"))


@register("newest_live_category_promo", ctes(PROMOTIONS_CTE) + f"""
SELECT target_category_id, id, discount_type, discount_value, {iso_sql('created_at')} AS created_at
FROM (SELECT *, row_number() OVER (PARTITION BY target_category_id
                                   ORDER BY created_at DESC NULLS LAST, id DESC) AS rn
      FROM promotions WHERE scope = 'CATEGORY' AND {live()}) t
WHERE rn = 1""")
def newest_live_category_promo(spark, sf_dir):
    """Newest live CATEGORY promotion per category."""
    promos = dt.promotions(spark, sf_dir)
    w = rules.live_category_winners(promos, dt.as_of_lit())
    return w.select("target_category_id", "id", "discount_type", "discount_value",
                    iso("created_at").alias("created_at"))


@register("promotion_overlaps", ctes(PROMOTIONS_CTE) + """
SELECT a.target_product_id AS product_id, a.id AS first_id, b.id AS second_id
FROM promotions a JOIN promotions b
  ON a.target_product_id = b.target_product_id AND a.id < b.id
 AND a.starts_at < b.ends_at AND b.starts_at < a.ends_at
WHERE a.scope = 'PRODUCT' AND b.scope = 'PRODUCT'""")
def promotion_overlaps(spark, sf_dir):
    """Pairs of PRODUCT promotions on one product with overlapping
    windows (any status), as a time-bucketed range join."""
    from shelfrate.plans.ranges import overlap_join
    pr = dt.promotions(spark, sf_dir).filter(F.col("scope") == "PRODUCT")
    a = pr.select(F.col("target_product_id").alias("a_key"), F.col("id").alias("first_id"),
                  F.col("starts_at").alias("a_s"), F.col("ends_at").alias("a_e"))
    b = pr.select(F.col("target_product_id").alias("b_key"), F.col("id").alias("second_id"),
                  F.col("starts_at").alias("b_s"), F.col("ends_at").alias("b_e"))
    j = overlap_join(a, b, "a_key", "b_key", "a_s", "a_e", "b_s", "b_e")
    return j.filter(F.col("first_id") < F.col("second_id")).select(
        F.col("a_key").alias("product_id"), "first_id", "second_id")


FIRST_CONFLICT_SQL = ctes(PRODUCTS_CTE, PROMOTIONS_CTE) + """,
cand AS (SELECT pr.*, p.category_id AS prod_cat FROM promotions pr
         LEFT JOIN products p ON pr.target_product_id = p.id),
ex AS (SELECT * FROM promotions WHERE status IN ('ACTIVE','SCHEDULED')),
pairs AS (
  SELECT c.id, c.scope, c.created_at AS cc, c.starts_at AS cs, c.ends_at AS ce,
         e.id AS eid, e.scope AS escope, e.created_at AS ec, e.starts_at AS es, e.ends_at AS ee
  FROM cand c JOIN ex e ON c.scope = 'PRODUCT' AND e.scope = 'PRODUCT'
                       AND e.target_product_id = c.target_product_id
  UNION ALL
  SELECT c.id, c.scope, c.created_at, c.starts_at, c.ends_at, e.id, e.scope, e.created_at, e.starts_at, e.ends_at
  FROM cand c JOIN ex e ON c.scope = 'PRODUCT' AND e.scope = 'CATEGORY'
                       AND e.target_category_id = c.prod_cat
  UNION ALL
  SELECT c.id, c.scope, c.created_at, c.starts_at, c.ends_at, e.id, e.scope, e.created_at, e.starts_at, e.ends_at
  FROM cand c JOIN ex e ON c.scope = 'CATEGORY' AND e.scope = 'CATEGORY'
                       AND e.target_category_id = c.target_category_id),
hits AS (SELECT * FROM pairs WHERE es < ce AND cs < ee AND (ec < cc OR (ec = cc AND eid < id)))
SELECT id, scope,
       CASE WHEN escope = 'PRODUCT' THEN 'EXISTING_PRODUCT_PROMOTION'
            ELSE 'EXISTING_CATEGORY_PROMOTION' END AS reason,
       eid AS conflicting_promotion_id
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ec ASC NULLS LAST, eid ASC) AS rn FROM hits) t
WHERE rn = 1"""


@register("first_conflict", FIRST_CONFLICT_SQL)
def first_conflict(spark, sf_dir):
    """For every promotion, the first (oldest created_at, then id)
    unfinished promotion created before it that applies to the same target
    with an overlapping window; CATEGORY requests see CATEGORY only."""
    from shelfrate.operators.admission import first_blockers
    pr = dt.promotions(spark, sf_dir)
    return first_blockers(pr, pr.filter(rules.is_unfinished()), dt.products(spark, sf_dir),
                          order_col="created_at")


@register("admit_promotions")
def admit_promotions(spark, sf_dir):
    """Requests created on/after the instant arrive in (created_at, id)
    order against the promotions that existed before it. No SQL oracle
    (sequential fold); checked against a brute-force fold in tests."""
    from shelfrate.operators.admission import admit
    pr = dt.promotions(spark, sf_dir)
    at = dt.as_of_lit()
    from shelfrate.functions.timeutil import epoch_micros
    requests = pr.filter(F.col("created_at") >= at)
    requests = requests.withColumn("arrival", epoch_micros(requests, "created_at"))
    existing = pr.filter(F.col("created_at") < at)
    return admit(requests, existing, dt.products(spark, sf_dir))
