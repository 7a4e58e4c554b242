"""Data-quality queries: CHECKs, foreign keys, uniqueness, request and patch validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrate.operators import quality as ql
from shelfrate.plans.catalog import register
from shelfrate.plans.sqltext import AS_OF_SQL, FEED_CTE, PRODUCTS_CTE, PROMOTIONS_CTE, ctes
from shelfrate.sources import driver_tables as dt


# Rows as an import could bring them: prices and stocks shifted below zero, requests with bad windows,
# targets and values.
IMPORTED_CTE = """imported_products AS (
  SELECT p_partkey AS id, CAST(p_retailprice AS DECIMAL(12,2)) - 950 AS base_price, p_size - 2 AS stock_quantity FROM part),
imported_promotions AS (
  SELECT id, scope, target_product_id, target_category_id, starts_at, ends_at,
         CAST(TRY_CAST(discount_value AS DECIMAL(12,2)) AS DECIMAL(12,2)) - 2 AS discount_value FROM requests)"""

@register("orphan_rows", ctes(PRODUCTS_CTE, PROMOTIONS_CTE, FEED_CTE) + """,
links AS (SELECT l_partkey AS product_id, l_orderkey AS promotion_id FROM lineitem)
SELECT 'product_promotions.product_id' AS fk, CAST(product_id AS VARCHAR) AS missing_key
FROM links WHERE product_id IS NOT NULL AND product_id NOT IN (SELECT id FROM products)
UNION ALL
SELECT 'product_promotions.promotion_id', CAST(promotion_id AS VARCHAR)
FROM links WHERE promotion_id IS NOT NULL AND promotion_id NOT IN (SELECT id FROM promotions)
UNION ALL
SELECT 'promotions.target_product_id', CAST(target_product_id AS VARCHAR)
FROM promotions WHERE target_product_id IS NOT NULL AND target_product_id NOT IN (SELECT id FROM products)
UNION ALL
SELECT 'feed.category_name', category_name
FROM feed WHERE category_name IS NOT NULL AND category_name NOT IN (SELECT p_brand FROM part)""")
def orphan_rows(spark, sf_dir):
    """Foreign keys without a parent (left anti joins): links taken
    from lineitem (part, order), promotion targets, feed category names."""
    products, promos = dt.products(spark, sf_dir), dt.promotions(spark, sf_dir)
    links = dt.read_table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("product_id"), F.col("l_orderkey").alias("promotion_id"))
    parts = [ql.orphans(links, "product_id", products, "id", "product_promotions.product_id"),
             ql.orphans(links, "promotion_id", promos, "id", "product_promotions.promotion_id"),
             ql.orphans(promos, "target_product_id", products, "id", "promotions.target_product_id"),
             ql.orphans(dt.feed(spark, sf_dir), "category_name", dt.categories(spark, sf_dir), "name",
                        "feed.category_name")]
    return reduce(DataFrame.unionByName, parts)


@register("duplicate_keys", ctes(FEED_CTE) + """
SELECT 'product_promotions_pkey' AS constraint_name,
       CAST(l_partkey AS VARCHAR) || '|' || CAST(l_orderkey AS VARCHAR) AS key, CAST(count(*) AS BIGINT) AS n
FROM lineitem GROUP BY l_partkey, l_orderkey HAVING count(*) > 1
UNION ALL
SELECT 'products_sku_key', sku, CAST(count(*) AS BIGINT) FROM feed GROUP BY sku HAVING count(*) > 1
UNION ALL
SELECT 'categories_name_key', p_brand, CAST(count(*) AS BIGINT) FROM part GROUP BY p_brand HAVING count(*) > 1""")
def duplicate_keys(spark, sf_dir):
    """Natural keys that occur more than once (link key from lineitem,
    feed skus, category names as listed per part)."""
    li = dt.read_table(spark, sf_dir, "lineitem")
    feed = dt.feed(spark, sf_dir)
    part = dt.read_table(spark, sf_dir, "part")
    return reduce(DataFrame.unionByName, [
        ql.duplicate_keys(li, ["l_partkey", "l_orderkey"], "product_promotions_pkey"),
        ql.duplicate_keys(feed, ["sku"], "products_sku_key"),
        ql.duplicate_keys(part, ["p_brand"], "categories_name_key")])


REQUESTS_CTE = """requests AS (
  SELECT o_orderkey AS id,
         CASE WHEN o_orderkey % 41 = 0 THEN '' ELSE 'promo-' || CAST(o_orderkey AS VARCHAR) END AS name,
         CASE WHEN o_orderkey % 43 = 0 THEN 'BOGO'
              WHEN o_orderkey % 3 = 0 THEN 'FIXED_AMOUNT' ELSE 'PERCENTAGE' END AS discount_type,
         CASE WHEN o_orderkey % 7 = 0
              THEN CAST(CAST(1 + o_orderkey % 60 AS DECIMAL(12,3)) + CAST(0.005 AS DECIMAL(4,3)) AS VARCHAR)
              ELSE CAST(CAST(1 + o_orderkey % 60 AS DECIMAL(12,2)) AS VARCHAR) END AS discount_value,
         CASE WHEN o_orderkey % 50 = 0 THEN 'CATEGORY' ELSE 'PRODUCT' END AS scope,
         CASE WHEN o_orderkey % 50 <> 0 OR o_orderkey % 17 = 0 THEN o_custkey END AS target_product_id,
         CASE WHEN o_orderkey % 50 = 0 THEN 'Brand#1' END AS target_category_id,
         o_orderdate AS starts_at,
         CASE WHEN o_orderkey % 19 = 0 THEN o_orderdate - INTERVAL 1 DAY
              ELSE o_orderdate + INTERVAL 30 DAY END AS ends_at
  FROM orders)"""


def _requests(spark, sf_dir):
    o = dt.read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("id"),
        F.when(k % 41 == 0, F.lit("")).otherwise(F.concat(F.lit("promo-"), k.cast("string"))).alias("name"),
        F.when(k % 43 == 0, F.lit("BOGO")).when(k % 3 == 0, F.lit("FIXED_AMOUNT"))
         .otherwise(F.lit("PERCENTAGE")).alias("discount_type"),
        F.when(k % 7 == 0, ((F.lit(1) + k % 60).cast("decimal(12,3)") + F.lit(0.005).cast("decimal(4,3)")).cast("string"))
         .otherwise((F.lit(1) + k % 60).cast("decimal(12,2)").cast("string")).alias("discount_value"),
        F.when(k % 50 == 0, F.lit("CATEGORY")).otherwise(F.lit("PRODUCT")).alias("scope"),
        F.when((k % 50 != 0) | (k % 17 == 0), F.col("o_custkey")).alias("target_product_id"),
        F.when(k % 50 == 0, F.lit("Brand#1")).alias("target_category_id"),
        F.col("o_orderdate").alias("starts_at"),
        F.when(k % 19 == 0, F.col("o_orderdate") - F.expr("INTERVAL 1 DAY"))
         .otherwise(F.col("o_orderdate") + F.expr("INTERVAL 30 DAY")).alias("ends_at"))


MONEY_RE = r"^\d+(\.\d{1,2})?\z"


def _len_sql(col, path, lo, hi, required=True):
    first = f"WHEN {col} IS NULL THEN '{path}: Required' " if required else ""
    return (f"CASE {first}WHEN length({col}) < {lo} THEN '{path}: String must contain at least {lo} character(s)' "
            f"WHEN length({col}) > {hi} THEN '{path}: String must contain at most {hi} character(s)' END")


@register("promotion_request_checks", ctes(REQUESTS_CTE) + f"""
SELECT id, NULLIF(concat_ws('; ',
    {_len_sql('name', 'name', 1, 255)},
    CASE WHEN discount_type NOT IN ('PERCENTAGE', 'FIXED_AMOUNT')
         THEN 'discountType: Invalid enum value. Expected ''PERCENTAGE'' | ''FIXED_AMOUNT''' END,
    CASE WHEN discount_value IS NULL THEN 'discountValue: Required'
         WHEN NOT regexp_matches(discount_value, '{MONEY_RE}')
         THEN 'discountValue: expected a decimal with up to 2 fractional digits' END,
    CASE WHEN scope NOT IN ('PRODUCT', 'CATEGORY')
         THEN 'scope: Invalid enum value. Expected ''PRODUCT'' | ''CATEGORY''' END,
    CASE WHEN ends_at <= starts_at THEN 'endsAt: endsAt must be after startsAt' END,
    CASE WHEN scope IN ('PRODUCT', 'CATEGORY') AND NOT (CASE WHEN scope = 'PRODUCT'
              THEN target_product_id IS NOT NULL AND target_category_id IS NULL
              ELSE target_category_id IS NOT NULL AND target_product_id IS NULL END)
         THEN 'scope: For scope=PRODUCT set targetProductId; for scope=CATEGORY set targetCategoryId. Set exactly one.' END,
    CASE WHEN ends_at <= {AS_OF_SQL} THEN 'endsAt must be in the future' END), '') AS errors
FROM requests""")
def promotion_request_checks(spark, sf_dir):
    """Create-promotion requests (derived from orders, with
    injected defects) checked against every rule; errors joined by '; '."""
    r = _requests(spark, sf_dir)
    return r.select("id", ql.promotion_request_errors(dt.as_of_lit()).alias("errors"))


PATCHES_CTE = """patches AS (
  SELECT p_partkey AS id,
         CASE WHEN p_partkey % 37 = 0 THEN NULL WHEN p_partkey % 23 = 0 THEN '' ELSE p_name END AS name,
         CASE WHEN p_partkey % 37 = 0 THEN NULL
              WHEN p_partkey % 29 = 0 THEN CAST(CAST(p_retailprice AS DECIMAL(12,3)) + CAST(0.001 AS DECIMAL(4,3)) AS VARCHAR)
              ELSE CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) END AS base_price,
         CASE WHEN p_partkey % 37 = 0 THEN NULL WHEN p_partkey % 31 = 0 THEN -p_size ELSE p_size END
           AS stock_quantity
  FROM part)"""


@register("product_patch_checks", ctes(PATCHES_CTE) + f"""
SELECT id, NULLIF(concat_ws('; ',
    {_len_sql('name', 'name', 1, 255, required=False)},
    CASE WHEN base_price IS NOT NULL AND NOT regexp_matches(base_price, '{MONEY_RE}')
         THEN 'basePrice: expected a decimal with up to 2 fractional digits' END,
    CASE WHEN stock_quantity < 0 THEN 'stockQuantity: Number must be greater than or equal to 0' END,
    CASE WHEN name IS NULL AND base_price IS NULL AND stock_quantity IS NULL
         THEN 'at least one field must be provided' END), '') AS errors
FROM patches""")
def product_patch_checks(spark, sf_dir):
    """V6 (V5 rules): partial product updates derived from part with defects."""
    p = dt.read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    patches = p.select(
        k.alias("id"),
        F.when(k % 37 == 0, F.lit(None)).when(k % 23 == 0, F.lit("")).otherwise(F.col("p_name")).alias("name"),
        F.when(k % 37 == 0, F.lit(None))
         .when(k % 29 == 0, (F.col("p_retailprice").cast("decimal(12,3)") + F.lit(0.001).cast("decimal(4,3)")).cast("string"))
         .otherwise(F.col("p_retailprice").cast("decimal(12,2)").cast("string")).alias("base_price"),
        F.when(k % 37 == 0, F.lit(None)).when(k % 31 == 0, -F.col("p_size")).otherwise(F.col("p_size"))
         .alias("stock_quantity"))
    return patches.select("id", ql.product_patch_errors().alias("errors"))


@register("constraint_violations", ctes(REQUESTS_CTE, IMPORTED_CTE) + """
SELECT 'products' AS table_name, CAST(id AS VARCHAR) AS id, 'base_price_nonnegative' AS rule
FROM imported_products WHERE base_price < 0
UNION ALL SELECT 'products', CAST(id AS VARCHAR), 'stock_nonnegative' FROM imported_products WHERE stock_quantity < 0
UNION ALL SELECT 'promotions', CAST(id AS VARCHAR), 'exactly_one_target' FROM imported_promotions
  WHERE NOT (CASE WHEN scope = 'PRODUCT' THEN target_product_id IS NOT NULL AND target_category_id IS NULL
                  ELSE target_category_id IS NOT NULL AND target_product_id IS NULL END)
UNION ALL SELECT 'promotions', CAST(id AS VARCHAR), 'ends_after_starts' FROM imported_promotions WHERE ends_at <= starts_at
UNION ALL SELECT 'promotions', CAST(id AS VARCHAR), 'discount_value_positive' FROM imported_promotions
  WHERE discount_value <= 0""")
def constraint_violations(spark, sf_dir):
    """Table CHECK constraints over imported rows, as violation rows."""
    part, money = dt.read_table(spark, sf_dir, "part"), "decimal(12,2)"
    products = part.select(F.col("p_partkey").alias("id"), (F.col("p_retailprice").cast(money) - 950).alias("base_price"),
                           (F.col("p_size") - 2).alias("stock_quantity"))
    promotions = _requests(spark, sf_dir).withColumn("discount_value", F.col("discount_value").try_cast(money) - 2)
    return ql.constraint_violations(products, promotions)
