"""Queries over the materialized product snapshot: apply, revert, cancel,
create, update, links, audits and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfrate.functions.money import effective_price
from shelfrate.operators import catalog, promote, rules
from shelfrate.plans.catalog import iso, iso_sql, register
from shelfrate.plans.sqltext import (AS_OF_SQL, PRODUCTS_CTE, PROMOTIONS_CTE, WINNER_CTES, ctes,
                                     live, price_sql)
from shelfrate.sources import driver_tables as dt

# ---------------------------------------------------------------- scenario
# state0: products carrying only their live PRODUCT winner (what PRODUCT
# promotion creation leaves behind). to_apply: per category the newest
# unfinished CATEGORY promotion created by the instant (apply does not test
# liveness, Q2). state1: state0 after applying them.

STATE0_CTES = f"""live AS (SELECT * FROM promotions WHERE {live()}),
pw AS (SELECT target_product_id, id, discount_type, discount_value FROM (
  SELECT *, row_number() OVER (PARTITION BY target_product_id
                               ORDER BY created_at DESC NULLS LAST, id DESC) AS rn
  FROM live WHERE scope = 'PRODUCT') t WHERE rn = 1),
state0 AS (
  SELECT p.id, p.sku, p.name, p.category_id, p.base_price, p.stock_quantity,
         pw.id AS active_promotion_id,
         {price_sql('p.base_price', 'pw.discount_type', 'pw.discount_value')} AS effective_price
  FROM products p LEFT JOIN pw ON p.id = pw.target_product_id),
ta AS (SELECT id, target_category_id, discount_type, discount_value FROM (
  SELECT *, row_number() OVER (PARTITION BY target_category_id
                               ORDER BY created_at DESC NULLS LAST, id DESC) AS rn
  FROM promotions WHERE scope = 'CATEGORY' AND status IN ('ACTIVE','SCHEDULED')
                        AND created_at <= {AS_OF_SQL}) t
  WHERE rn = 1),
liveprod AS (SELECT id FROM live WHERE scope = 'PRODUCT'),
state1 AS (
  SELECT s.id, s.sku, s.name, s.category_id, s.base_price, s.stock_quantity,
         CASE WHEN ta.id IS NOT NULL AND lp.id IS NULL THEN ta.id ELSE s.active_promotion_id END
           AS active_promotion_id,
         CASE WHEN ta.id IS NOT NULL AND lp.id IS NULL
              THEN {price_sql('s.base_price', 'ta.discount_type', 'ta.discount_value')}
              ELSE s.effective_price END AS effective_price,
         (ta.id IS NOT NULL AND lp.id IS NULL) AS changed
  FROM state0 s
  LEFT JOIN liveprod lp ON s.active_promotion_id = lp.id
  LEFT JOIN ta ON s.category_id = ta.target_category_id)"""

BASE = ctes(PRODUCTS_CTE, PROMOTIONS_CTE) + ", " + STATE0_CTES + "\n"


def _state0(spark, sf_dir):
    products, promos, at = dt.products(spark, sf_dir), dt.promotions(spark, sf_dir), dt.as_of_lit()
    pw = rules.live_product_winners(promos, at).select(
        F.col("target_product_id").alias("__pid"), F.col("id").alias("active_promotion_id"),
        F.col("discount_type").alias("__t"), F.col("discount_value").alias("__v"))
    from shelfrate.plans.joins import join_small
    s = join_small(products, pw, products["id"] == pw["__pid"], "left")
    return (s.withColumn("effective_price", effective_price("base_price", "__t", "__v"))
             .drop("__pid", "__t", "__v")), promos, at


def _to_apply(promos, at):
    return promos.filter((F.col("scope") == "CATEGORY") & rules.is_unfinished()
                         & (F.col("created_at") <= at))


def _applied(promos, at):
    """The one promotion per category that ends up applied (newest)."""
    return rules.top1_per_key(_to_apply(promos, at), "target_category_id",
                              [F.col("created_at").desc_nulls_last(), F.col("id").desc()])


def _state1(spark, sf_dir):
    s0, promos, at = _state0(spark, sf_dir)
    s1, changes = promote.apply_category(s0, promos, _to_apply(promos, at), at)
    return s0, s1, changes, promos, at


SNAP_COLS = ["id", "category_id", "base_price", "active_promotion_id", "effective_price", "changed"]


@register("apply_category", BASE + "SELECT " + ", ".join(SNAP_COLS) + " FROM state1")
def apply_category(spark, sf_dir):
    """Category promotions applied to the snapshot, outranked
    products (live PRODUCT holder) skipped."""
    _, s1, _, _, _ = _state1(spark, sf_dir)
    return s1.select(*SNAP_COLS)


@register("apply_links", BASE + """
SELECT p.id AS product_id, ta.id AS promotion_id
FROM products p JOIN ta ON p.category_id = ta.target_category_id
WHERE NOT EXISTS (SELECT 1 FROM state0 s WHERE s.id = p.id AND s.active_promotion_id = ta.id)""")
def apply_links(spark, sf_dir):
    """M3: link rows for all products of each applied category (also the
    outranked ones), insert-ignore against the existing links."""
    s0, promos, at = _state0(spark, sf_dir)
    links = s0.filter(F.col("active_promotion_id").isNotNull()).select(
        F.col("id").alias("product_id"), F.col("active_promotion_id").alias("promotion_id"))
    return promote.category_links(dt.products(spark, sf_dir), _applied(promos, at), links)


@register("apply_changeset", BASE + """
SELECT 'product:' || CAST(id AS VARCHAR) AS cache_key,
       CAST(floor((row_number() OVER (ORDER BY id) - 1) / 1000) AS BIGINT) AS group_index
FROM state1 WHERE changed""")
def apply_changeset(spark, sf_dir):
    """Invalidation keys of the changed products in groups of 1000."""
    _, _, changes, _, _ = _state1(spark, sf_dir)
    return promote.invalidation_keys(changes)


@register("revert_category", BASE + f""",
rv AS (SELECT id FROM ta t WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.id = t.id))
SELECT s.id, s.category_id, s.base_price,
       CASE WHEN rv.id IS NOT NULL THEN NULL ELSE s.active_promotion_id END AS active_promotion_id,
       CASE WHEN rv.id IS NOT NULL THEN CAST(round(s.base_price, 2) AS DECIMAL(12,2))
            ELSE s.effective_price END AS effective_price,
       (rv.id IS NOT NULL) AS changed
FROM state1 s LEFT JOIN rv ON s.active_promotion_id = rv.id""".replace("SELECT s.id", "SELECT s.id", 1))
def revert_category(spark, sf_dir):
    """M5: the applied category promotions whose window is not live at the
    instant are reverted: holders go back to base price, no promotion."""
    _, s1, _, promos, at = _state1(spark, sf_dir)
    rv = _applied(promos, at).filter(~rules.is_live(at)).select("id")
    out, _ = promote.revert_category(s1.drop("changed"), rv)
    return out.select(*SNAP_COLS)


CANCEL_SQL = ctes(PRODUCTS_CTE, PROMOTIONS_CTE) + ", " + WINNER_CTES + f""",
cx AS (SELECT id FROM promotions WHERE scope = 'PRODUCT' AND discount_type = 'FIXED_AMOUNT' AND {live()}),
after AS (SELECT id, scope, target_product_id, target_category_id, discount_type, discount_value,
                 starts_at, ends_at, created_at,
                 CASE WHEN id IN (SELECT id FROM cx) THEN 'CANCELLED' ELSE status END AS status
          FROM promotions),
live2 AS (SELECT * FROM after WHERE {live()}),
pw2 AS (SELECT target_product_id, id, discount_type, discount_value FROM (
  SELECT *, row_number() OVER (PARTITION BY target_product_id
                               ORDER BY created_at DESC NULLS LAST, id DESC) AS rn
  FROM live2 WHERE scope = 'PRODUCT') t WHERE rn = 1),
cw2 AS (SELECT target_category_id, id, discount_type, discount_value FROM (
  SELECT *, row_number() OVER (PARTITION BY target_category_id
                               ORDER BY created_at DESC NULLS LAST, id DESC) AS rn
  FROM live2 WHERE scope = 'CATEGORY') t WHERE rn = 1),
carriers AS (SELECT s.* FROM state s WHERE s.winner_id IN (SELECT id FROM cx)),
redone AS (
  SELECT c.id, c.base_price,
         CASE WHEN pw2.id IS NOT NULL THEN pw2.id ELSE cw2.id END AS active_promotion_id,
         {price_sql('c.base_price', 'CASE WHEN pw2.id IS NOT NULL THEN pw2.discount_type ELSE cw2.discount_type END', 'CASE WHEN pw2.id IS NOT NULL THEN pw2.discount_value ELSE cw2.discount_value END')}
           AS effective_price,
         true AS changed
  FROM carriers c LEFT JOIN pw2 ON c.id = pw2.target_product_id
  LEFT JOIN cw2 ON c.category_id = cw2.target_category_id)
SELECT id, base_price, active_promotion_id, effective_price, changed FROM redone
UNION ALL
SELECT id, base_price, winner_id AS active_promotion_id, effective_price, false AS changed
FROM state WHERE winner_id IS NULL OR winner_id NOT IN (SELECT id FROM cx)"""


@register("cancel_product", CANCEL_SQL)
def cancel_product(spark, sf_dir):
    """M6: cancel every live FIXED_AMOUNT PRODUCT promotion; their carriers
    are re-evaluated with the winner rule over what stays live."""
    from shelfrate.plans.pricing_queries import _state
    s = _state(spark, sf_dir)
    promos, at = dt.promotions(spark, sf_dir), dt.as_of_lit()
    cx = promos.filter((F.col("scope") == "PRODUCT") & (F.col("discount_type") == "FIXED_AMOUNT")
                       & rules.is_live(at)).select("id")
    out, _ = promote.cancel_product(
        s.select("id", "category_id", "base_price", "active_promotion_id", "effective_price"),
        promos, cx, at)
    return out.select("id", "base_price", "active_promotion_id", "effective_price", "changed")


NEW_PRODUCTS_CTE = """newp AS (
  SELECT 'NEW-' || CAST(p_partkey AS VARCHAR) AS id, 'NEW-SKU-' || CAST(p_partkey AS VARCHAR) AS sku,
         p_brand AS category_id, CAST(p_retailprice AS DECIMAL(12,2)) AS base_price
  FROM part)"""


def _new_products(spark, sf_dir):
    p = dt.read_table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("NEW-"), F.col("p_partkey").cast("string")).alias("id"),
                    F.concat(F.lit("NEW-SKU-"), F.col("p_partkey").cast("string")).alias("sku"),
                    F.col("p_brand").alias("category_id"),
                    F.col("p_retailprice").cast("decimal(12,2)").alias("base_price"))


@register("create_products_autojoin", ctes(PROMOTIONS_CTE, NEW_PRODUCTS_CTE) + f""",
cw AS (SELECT target_category_id, id, discount_type, discount_value FROM (
  SELECT *, row_number() OVER (PARTITION BY target_category_id
                               ORDER BY created_at DESC NULLS LAST, id DESC) AS rn
  FROM promotions WHERE scope = 'CATEGORY' AND {live()}) t WHERE rn = 1)
SELECT n.id, n.sku, n.category_id, n.base_price, cw.id AS active_promotion_id,
       {price_sql('n.base_price', 'cw.discount_type', 'cw.discount_value')} AS effective_price
FROM newp n LEFT JOIN cw ON n.category_id = cw.target_category_id""")
def create_products_autojoin(spark, sf_dir):
    """M8: new products take the newest live CATEGORY promotion of their category."""
    rows, _ = catalog.create_products(_new_products(spark, sf_dir), dt.promotions(spark, sf_dir),
                                      dt.as_of_lit())
    return rows.select("id", "sku", "category_id", "base_price", "active_promotion_id", "effective_price")


@register("update_products_reprice", ctes(PRODUCTS_CTE, PROMOTIONS_CTE) + ", " + WINNER_CTES + f""",
patch AS (SELECT p_partkey AS id, CAST(p_retailprice AS DECIMAL(12,2)) * CAST(1.05 AS DECIMAL(3,2)) AS nb,
                 p_size + 1 AS ns FROM part)
SELECT s.id, s.name, CAST(round(pt.nb, 2) AS DECIMAL(12,2)) AS base_price, pt.ns AS stock_quantity,
       s.winner_id AS active_promotion_id,
       {price_sql('pt.nb', 'pr.discount_type', 'pr.discount_value')} AS effective_price
FROM state s JOIN patch pt ON s.id = pt.id
LEFT JOIN promotions pr ON s.winner_id = pr.id""")
def update_products_reprice(spark, sf_dir):
    """Base price +5 % and stock +1 for every product; re-priced
    under the held promotion (no liveness test, Q12)."""
    from shelfrate.plans.pricing_queries import _state
    s = _state(spark, sf_dir).select("id", "name", "category_id", "base_price", "stock_quantity",
                                     "active_promotion_id", "effective_price")
    p = dt.read_table(spark, sf_dir, "part")
    patches = p.select(F.col("p_partkey").alias("id"), F.lit(None).cast("string").alias("name"),
                       (F.col("p_retailprice").cast("decimal(12,2)") * F.lit(1.05).cast("decimal(3,2)")
                        ).alias("base_price"),
                       (F.col("p_size") + 1).alias("stock_quantity"))
    out = catalog.update_products(s, patches, dt.promotions(spark, sf_dir))
    return out.select("id", "name", "base_price", "stock_quantity", "active_promotion_id", "effective_price")


@register("links_per_promotion", BASE + """,
links AS (SELECT id AS product_id, active_promotion_id AS promotion_id FROM state0
          WHERE active_promotion_id IS NOT NULL
          UNION
          SELECT p.id, ta.id FROM products p JOIN ta ON p.category_id = ta.target_category_id)
SELECT promotion_id, CAST(count(*) AS BIGINT) AS products FROM links GROUP BY promotion_id""")
def links_per_promotion(spark, sf_dir):
    """A12 + M3: products that carried each promotion (link history)."""
    s0, promos, at = _state0(spark, sf_dir)
    links = s0.filter(F.col("active_promotion_id").isNotNull()).select(
        F.col("id").alias("product_id"), F.col("active_promotion_id").alias("promotion_id"))
    new = promote.category_links(dt.products(spark, sf_dir), _applied(promos, at), links)
    all_links = links.unionByName(new)
    return all_links.groupBy("promotion_id").agg(F.count(F.lit(1)).cast("bigint").alias("products"))


@register("stale_hold_audit", BASE + f"""
SELECT s.id, s.active_promotion_id, pr.status,
       CASE WHEN pr.status <> 'ACTIVE' THEN 'NOT_ACTIVE' ELSE 'OUTSIDE_WINDOW' END AS issue
FROM state1 s JOIN promotions pr ON s.active_promotion_id = pr.id
WHERE NOT (pr.status = 'ACTIVE' AND pr.starts_at <= {AS_OF_SQL} AND {AS_OF_SQL} < pr.ends_at)""")
def stale_hold_audit(spark, sf_dir):
    """Q3/Q12 audit: products holding a promotion that the ingest rule
    would not price (not ACTIVE, or outside its window)."""
    _, s1, _, promos, at = _state1(spark, sf_dir)
    pr = promos.select(F.col("id").alias("__pid"), "status", "starts_at", "ends_at")
    j = s1.join(pr, s1["active_promotion_id"] == pr["__pid"], "inner")
    return (j.filter(~rules.is_live_strict(at))
             .select("id", "active_promotion_id", "status",
                     F.when(F.col("status") != "ACTIVE", F.lit("NOT_ACTIVE"))
                      .otherwise(F.lit("OUTSIDE_WINDOW")).alias("issue")))


@register("product_view", ctes(PRODUCTS_CTE, PROMOTIONS_CTE) + ", " + WINNER_CTES + f"""
SELECT id, sku, name, category_id, CAST(CAST(base_price AS DECIMAL(12,2)) AS VARCHAR) AS base_price,
       stock_quantity, winner_id AS active_promotion_id,
       CAST(effective_price AS VARCHAR) AS effective_price,
       {iso_sql(AS_OF_SQL)} AS effective_price_updated_at
FROM state""")
def product_view(spark, sf_dir):
    """The priced snapshot as the API presents it."""
    from shelfrate.plans.pricing_queries import _state
    s = _state(spark, sf_dir).withColumn("effective_price_updated_at", dt.as_of_lit())
    return catalog.product_view(s.select("id", "sku", "name", "category_id", "base_price",
                                         "stock_quantity", "active_promotion_id", "effective_price",
                                         "effective_price_updated_at"))


@register("promotion_view", ctes(PROMOTIONS_CTE) + f"""
SELECT id, name, discount_type, CAST(discount_value AS VARCHAR) AS discount_value, scope,
       target_product_id, target_category_id, {iso_sql('starts_at')} AS starts_at,
       {iso_sql('ends_at')} AS ends_at, status, {iso_sql('created_at')} AS created_at
FROM promotions""")
def promotion_view(spark, sf_dir):
    """P2."""
    return catalog.promotion_view(dt.promotions(spark, sf_dir))


@register("latest_promotions", ctes(PROMOTIONS_CTE) + f"""
SELECT id, scope, status, {iso_sql('created_at')} AS created_at,
       CAST(row_number() OVER (ORDER BY created_at DESC, id DESC) AS BIGINT) AS position
FROM promotions WHERE status = 'ACTIVE' AND scope = 'PRODUCT'
ORDER BY created_at DESC, id DESC LIMIT 20""")
def latest_promotions(spark, sf_dir):
    """The 20 newest ACTIVE PRODUCT promotions (the limit is the feature)."""
    top = catalog.latest_promotions(dt.promotions(spark, sf_dir), 20, status="ACTIVE", scope="PRODUCT")
    rows = top.select("id", "scope", "status", "created_at").collect()  # <= 20 rows
    data = [(r["id"], r["scope"], r["status"], r["created_at"], i + 1) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, scope string, status string, created_at timestamp_ntz, position long")
    return df.select("id", "scope", "status", iso("created_at").alias("created_at"), "position")


@register("categories_sorted", """
SELECT p_brand AS id, p_brand AS name, CAST(row_number() OVER (ORDER BY p_brand) AS BIGINT) AS position
FROM (SELECT DISTINCT p_brand FROM part) t""")
def categories_sorted(spark, sf_dir):
    """L4: categories by name with their position (distributed numbering)."""
    from shelfrate.plans.ordering import global_row_number
    cats = dt.categories(spark, sf_dir)
    return global_row_number(cats, [F.col("name").asc()], out="position").select("id", "name", "position")


@register("apply_revert_counts", BASE + """,
rv AS (SELECT id FROM ta t WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.id = t.id))
SELECT 'apply' AS kind, CAST(count(*) AS BIGINT) AS affected FROM state1 WHERE changed
UNION ALL
SELECT 'revert', CAST(count(*) AS BIGINT) FROM state1 s JOIN rv ON s.active_promotion_id = rv.id""")
def apply_revert_counts(spark, sf_dir):
    """Affected-product counts of the apply and revert change sets."""
    _, s1, changes, promos, at = _state1(spark, sf_dir)
    rv = _applied(promos, at).filter(~rules.is_live(at)).select("id")
    _, rchanges = promote.revert_category(s1.drop("changed"), rv)
    return (changes.agg(F.count(F.lit(1)).cast("bigint").alias("affected")).select(F.lit("apply").alias("kind"), "affected")
            .unionByName(rchanges.agg(F.count(F.lit(1)).cast("bigint").alias("affected"))
                         .select(F.lit("revert").alias("kind"), "affected")))
