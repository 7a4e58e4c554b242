"""Queries for the request side: listings, views, checks of requests, conflicts, lookups, re-registration."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfrate.functions.money import price_input_error
from shelfrate.operators import catalog, ledger, promote, rules
from shelfrate.operators import quality as ql
from shelfrate.plans.catalog import ORACLE, iso, iso_sql, register
from shelfrate.plans.feed_queries import REGISTER_SQL, _arrivals
from shelfrate.plans.listing_queries import STATE, _cursor_sql
from shelfrate.plans.pricing_queries import FIRST_CONFLICT_SQL, first_conflict
from shelfrate.plans.quality_queries import MONEY_RE, REQUESTS_CTE, _len_sql, _requests
from shelfrate.plans.sqltext import AS_OF_SQL, PRODUCTS_CTE, PROMOTIONS_CTE, ctes, live, price_sql
from shelfrate.sources import driver_tables as dt

CATEGORY = "Brand#11"


def _state(spark, sf_dir):
    from shelfrate.plans.pricing_queries import _state as state
    return state(spark, sf_dir)


@register("listing_category_desc", STATE + f""",
ranked AS (SELECT id, name, row_number() OVER (ORDER BY name DESC, id DESC) AS rn, count(*) OVER () AS total
  FROM state WHERE category_id = '{CATEGORY}')
SELECT r.id, r.name, r.rn AS page_pos, nc.next_cursor FROM ranked r
LEFT JOIN (SELECT CASE WHEN total > 20 THEN {_cursor_sql('name', 'id')} END AS next_cursor FROM ranked WHERE rn = 20) nc
  ON true WHERE r.rn <= 20""")
def listing_category_desc(spark, sf_dir):
    """F8 L1: first page of one category by name, descending."""
    s = _state(spark, sf_dir).select("id", "name", "category_id")
    return catalog.keyset_page(s, "name", "desc", 20, category_id=CATEGORY).select("id", "name", "page_pos", "next_cursor")


@register("listing_last_page", STATE + """,
ranked AS (SELECT id, effective_price, row_number() OVER (ORDER BY effective_price, id) AS rn FROM state)
SELECT id, effective_price, 8 - rn AS page_pos, CAST(NULL AS VARCHAR) AS next_cursor FROM ranked WHERE rn < 8""")
def listing_last_page(spark, sf_dir):
    """The last page of the descending listing has no next cursor."""
    s = _state(spark, sf_dir).select("id", "effective_price")
    cursor = catalog.keyset_page(s, "effective_price", "asc", 8).select("next_cursor").first()[0]
    return catalog.keyset_page(s, "effective_price", "desc", 20, cursor=cursor).select(
        "id", "effective_price", "page_pos", "next_cursor")


NEW_PRODUCTS_CTE = """fresh AS (
  SELECT p_partkey AS id, CASE WHEN p_partkey % 53 = 0 THEN repeat('x', 65) ELSE 'SKU-' || CAST(p_partkey AS VARCHAR) END AS sku,
    CASE WHEN p_partkey % 23 = 0 THEN '' ELSE p_name END AS name,
    CASE WHEN p_partkey % 47 = 0 THEN NULL ELSE p_brand END AS category_id,
    CASE WHEN p_partkey % 29 = 0 THEN '1.234' WHEN p_partkey % 59 = 0 THEN NULL
      ELSE CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) END AS base_price,
    CASE WHEN p_partkey % 31 = 0 THEN -p_size ELSE p_size END AS stock_quantity FROM part)"""


@register("product_create_checks", ctes(NEW_PRODUCTS_CTE) + f"""
SELECT id, NULLIF(concat_ws('; ', {_len_sql('sku', 'sku', 1, 64)}, {_len_sql('name', 'name', 1, 255)},
    CASE WHEN category_id IS NULL THEN 'categoryId: Required' END,
    CASE WHEN base_price IS NULL THEN 'basePrice: Required' WHEN NOT regexp_matches(base_price, '{MONEY_RE}')
         THEN 'basePrice: expected a decimal with up to 2 fractional digits' END,
    CASE WHEN stock_quantity IS NULL THEN 'stockQuantity: Required'
         WHEN stock_quantity < 0 THEN 'stockQuantity: Number must be greater than or equal to 0' END), '') AS errors
FROM fresh""")
def product_create_checks(spark, sf_dir):
    """V5: product creation requests derived from part with defects."""
    k = F.col("p_partkey")
    fresh = dt.read_table(spark, sf_dir, "part").select(
        k.alias("id"), F.when(k % 53 == 0, F.repeat(F.lit("x"), 65)).otherwise(
            F.concat(F.lit("SKU-"), k.cast("string"))).alias("sku"),
        F.when(k % 23 == 0, F.lit("")).otherwise(F.col("p_name")).alias("name"),
        F.when(k % 47 != 0, F.col("p_brand")).alias("category_id"),
        F.when(k % 29 == 0, F.lit("1.234")).when(k % 59 == 0, F.lit(None))
         .otherwise(F.col("p_retailprice").cast("decimal(12,2)").cast("string")).alias("base_price"),
        F.when(k % 31 == 0, -F.col("p_size")).otherwise(F.col("p_size")).alias("stock_quantity"))
    return fresh.select("id", ql.product_create_errors().alias("errors"))


@register("price_input_checks", """
SELECT l_orderkey, l_linenumber,
  CASE WHEN CAST(l_extendedprice AS DECIMAL(12,2)) - 30000 < 0 THEN 'basePrice must be >= 0'
       WHEN l_linenumber % 4 <> 0 AND CAST(l_quantity AS DECIMAL(12,2)) - 5 <= 0 THEN 'discountValue must be > 0' END AS error
FROM lineitem""")
def price_input_checks(spark, sf_dir):
    """Price inputs (base, discount type, discount value) from lineitem, some of them invalid."""
    li = dt.read_table(spark, sf_dir, "lineitem")
    base = F.col("l_extendedprice").cast("decimal(12,2)") - F.lit(30000)
    kind = F.when(F.col("l_linenumber") % 4 != 0, F.lit("FIXED_AMOUNT"))
    value = F.col("l_quantity").cast("decimal(12,2)") - F.lit(5)
    return li.select("l_orderkey", "l_linenumber", price_input_error(base, kind, value).alias("error"))


@register("cancel_checks", ctes(PROMOTIONS_CTE) + """,
wanted AS (SELECT DISTINCT l_orderkey + CASE WHEN l_linenumber = 7 THEN 100000000 ELSE 0 END AS id FROM lineitem)
SELECT w.id, CASE WHEN p.id IS NULL THEN 'Promotion ' || CAST(w.id AS VARCHAR) || ' not found'
                  ELSE 'Promotion is already cancelled' END AS reason
FROM wanted w LEFT JOIN promotions p ON p.id = w.id WHERE p.id IS NULL OR p.status = 'CANCELLED'""")
def cancel_checks(spark, sf_dir):
    """Cancellations refused because the promotion is unknown or already cancelled."""
    li = dt.read_table(spark, sf_dir, "lineitem")
    ids = li.select((F.col("l_orderkey") + F.when(F.col("l_linenumber") == 7, 100000000).otherwise(0)).alias("id"))
    return promote.cancel_refusals(dt.promotions(spark, sf_dir), ids)


@register("category_views", f"""
SELECT p_brand AS id, p_brand AS name, {iso_sql("max(make_timestamp(2020, 1, 1 + CAST(p_size % 28 AS INTEGER), 1, 2, 3.5))")} AS created_at
FROM part GROUP BY p_brand""")
def category_views(spark, sf_dir):
    """Category view with its ISO-8601 time."""
    part = dt.read_table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("id")).agg(
        F.max(F.expr("make_timestamp_ntz(2020, 1, 1 + p_size % 28, 1, 2, 3.5)")).alias("created_at"))
    return catalog.category_view(part.withColumn("name", F.col("id")))


@register("category_create_checks", """
WITH names AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 13 = 0 THEN repeat('n', 256)
    WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_type END AS name FROM part)
SELECT n.id, CASE WHEN n.name IS NULL THEN 'name: Required'
  WHEN length(n.name) < 1 THEN 'name: String must contain at least 1 character(s)'
  WHEN length(n.name) > 255 THEN 'name: String must contain at most 255 character(s)'
  WHEN b.p_brand IS NOT NULL THEN 'Category "' || n.name || '" already exists' END AS error
FROM names n LEFT JOIN (SELECT DISTINCT p_brand FROM part) b ON b.p_brand = n.name""")
def category_create_checks(spark, sf_dir):
    """V8: category names from part, some too short, too long, missing or taken."""
    k = F.col("p_partkey")
    names = dt.read_table(spark, sf_dir, "part").select(
        k.alias("id"), F.when(k % 11 == 0, F.lit("")).when(k % 13 == 0, F.repeat(F.lit("n"), 256))
        .when(k % 17 == 0, F.lit(None)).when(k % 3 == 0, F.col("p_brand")).otherwise(F.col("p_type")).alias("name"))
    return ql.category_create_errors(names, dt.categories(spark, sf_dir)).select("id", "error")


@register("conflict_payloads", f"""SELECT id, reason, conflicting_promotion_id, '{rules.CONFLICT_ERROR}' AS error,
  '{rules.CONFLICT_MESSAGE}' AS message FROM ({FIRST_CONFLICT_SQL}) c""")
def conflict_payloads(spark, sf_dir):
    """The answer to each conflicting promotion."""
    found = first_conflict(spark, sf_dir).withColumnRenamed("conflicting_promotion_id", "existing_id")
    return rules.conflict_payload(found).select("id", "reason", "conflicting_promotion_id", "error", "message")


@register("find_products", ctes(PRODUCTS_CTE) + """
SELECT id, sku, name FROM products WHERE id IN (SELECT o_custkey FROM orders)""")
def find_products(spark, sf_dir):
    """Products looked up by the keys that the orders name."""
    keys = dt.read_table(spark, sf_dir, "orders").select("o_custkey")
    return catalog.find_by_ids(dt.products(spark, sf_dir), keys).select("id", "sku", "name")


@register("batch_register_again", REGISTER_SQL + f""",
known AS (SELECT DISTINCT vendor_id, source_file FROM checked_arr WHERE error IS NULL AND arrival % 3 = 0)
SELECT d.vendor_id, d.source_file, d.arrival, d.batch_id,
  CASE WHEN d.decision = 'CREATED' AND k.vendor_id IS NOT NULL THEN 'EXISTING' ELSE d.decision END AS decision, d.error
FROM decisions d LEFT JOIN known k ON d.vendor_id = k.vendor_id AND d.source_file = k.source_file""")
def batch_register_again(spark, sf_dir):
    """Arrivals against a ledger that knows some of them already."""
    arrivals, at = _arrivals(spark, sf_dir), dt.as_of_lit()
    before = ledger.register_batches(arrivals.where(F.col("arrival") % 3 == 0), None, at)
    return ledger.register_batches(arrivals, ledger.new_batches(before, at), at)


REQUEST_REFUSALS_SQL = ctes(REQUESTS_CTE, PRODUCTS_CTE) + f""",
form AS (SELECT *, NULLIF(concat_ws('; ', {_len_sql('name', 'name', 1, 255)},
    CASE WHEN discount_type NOT IN ('PERCENTAGE', 'FIXED_AMOUNT')
         THEN 'discountType: Invalid enum value. Expected ''PERCENTAGE'' | ''FIXED_AMOUNT''' END,
    CASE WHEN NOT regexp_matches(discount_value, '{MONEY_RE}')
         THEN 'discountValue: expected a decimal with up to 2 fractional digits' END,
    CASE WHEN ends_at <= starts_at THEN 'endsAt: endsAt must be after startsAt' END,
    CASE WHEN NOT (CASE WHEN scope = 'PRODUCT' THEN target_product_id IS NOT NULL AND target_category_id IS NULL
                        ELSE target_category_id IS NOT NULL AND target_product_id IS NULL END)
         THEN 'scope: For scope=PRODUCT set targetProductId; for scope=CATEGORY set targetCategoryId. Set exactly one.' END,
    CASE WHEN ends_at <= {AS_OF_SQL} THEN 'endsAt must be in the future' END), '') AS errors FROM requests)
SELECT id, coalesce(errors, CASE WHEN scope = 'PRODUCT' THEN 'Product ' || CAST(target_product_id AS VARCHAR) || ' not found'
                                 ELSE 'Category ' || target_category_id || ' not found' END) AS reason
FROM form WHERE errors IS NOT NULL
  OR (scope = 'PRODUCT' AND target_product_id NOT IN (SELECT id FROM products))
  OR (scope = 'CATEGORY' AND target_category_id NOT IN (SELECT category_id FROM products))"""


@register("promotion_refusals", REQUEST_REFUSALS_SQL)
def promotion_refusals(spark, sf_dir):
    """Creation requests that are refused before any conflict is looked for, with the reason."""
    return promote.request_refusals(_requests(spark, sf_dir), dt.products(spark, sf_dir), dt.as_of_lit())


@register("cancel_category", STATE + f""",
cx AS (SELECT id FROM promotions WHERE scope = 'CATEGORY' AND discount_type = 'PERCENTAGE' AND {live()})
SELECT s.id, s.base_price, CASE WHEN cx.id IS NULL THEN s.winner_id END AS active_promotion_id,
  CASE WHEN cx.id IS NULL THEN s.effective_price ELSE {price_sql('s.base_price', 'NULL', 'NULL')} END AS effective_price,
  cx.id IS NOT NULL AS changed,
  CASE WHEN cx.id IS NULL THEN NULL ELSE {iso_sql(AS_OF_SQL)} END AS updated_at
FROM state s LEFT JOIN cx ON s.winner_id = cx.id""")
def cancel_category(spark, sf_dir):
    """M7: cancelled category promotions leave their products, which are stamped with the time."""
    promos, at = dt.promotions(spark, sf_dir), dt.as_of_lit()
    cx = promos.where((F.col("scope") == "CATEGORY") & (F.col("discount_type") == "PERCENTAGE") & rules.is_live(at))
    state = _state(spark, sf_dir).withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    _, snap, _ = promote.cancel_category(state, promos, cx.select("id"), at)
    return snap.select("id", "base_price", "active_promotion_id", "effective_price", "changed",
                       iso("updated_at").alias("updated_at"))


def _fold_sql(name: str, source: str, key: str) -> str:
    """A recursive fold: requests of one target in order, each against the windows accepted before it."""
    free = "len(list_filter(f.acc, lambda x: x.s < r.ends_at AND r.starts_at < x.e)) = 0"
    return f"""{name} AS (
  SELECT {key} AS k, n, id, true AS ok, [{{'s': starts_at, 'e': ends_at}}] AS acc FROM {source} WHERE n = 1
  UNION ALL
  SELECT f.k, r.n, r.id, {free}, CASE WHEN {free}
    THEN list_append(f.acc, {{'s': r.starts_at, 'e': r.ends_at}}) ELSE f.acc END
  FROM {name} f JOIN {source} r ON r.{key} = f.k AND r.n = f.n + 1)"""


ADMIT_SQL = "WITH RECURSIVE " + PRODUCTS_CTE + ",\n" + PROMOTIONS_CTE + f""",
req AS (SELECT r.*, p.category_id AS pcat FROM promotions r LEFT JOIN products p ON p.id = r.target_product_id
  WHERE r.created_at >= {AS_OF_SQL}),
ex AS (SELECT * FROM promotions WHERE created_at < {AS_OF_SQL} AND status IN ('ACTIVE', 'SCHEDULED')),
cat_free AS (SELECT *, row_number() OVER (PARTITION BY target_category_id ORDER BY created_at, id) AS n FROM req r
  WHERE scope = 'CATEGORY' AND NOT EXISTS (SELECT 1 FROM ex e WHERE e.scope = 'CATEGORY'
    AND e.target_category_id = r.target_category_id AND e.starts_at < r.ends_at AND r.starts_at < e.ends_at)),
{_fold_sql('cat_fold', 'cat_free', 'target_category_id')},
cat_ok AS (SELECT * FROM req WHERE id IN (SELECT id FROM cat_fold WHERE ok)),
prod_free AS (SELECT *, row_number() OVER (PARTITION BY target_product_id ORDER BY created_at, id) AS n FROM req r
  WHERE scope = 'PRODUCT' AND NOT EXISTS (SELECT 1 FROM ex e WHERE e.scope = 'PRODUCT'
      AND e.target_product_id = r.target_product_id AND e.starts_at < r.ends_at AND r.starts_at < e.ends_at)
    AND NOT EXISTS (SELECT 1 FROM ex e WHERE e.scope = 'CATEGORY'
      AND e.target_category_id = r.pcat AND e.starts_at < r.ends_at AND r.starts_at < e.ends_at)
    AND NOT EXISTS (SELECT 1 FROM cat_ok e WHERE e.target_category_id = r.pcat AND e.starts_at < r.ends_at
      AND r.starts_at < e.ends_at AND (e.created_at < r.created_at OR (e.created_at = r.created_at AND e.id < r.id)))),
{_fold_sql('prod_fold', 'prod_free', 'target_product_id')},
ok AS (SELECT id FROM cat_ok UNION ALL SELECT id FROM prod_fold WHERE ok),
blockers AS (SELECT id, scope, target_product_id, target_category_id, starts_at, ends_at, created_at, true AS old FROM ex
  UNION ALL SELECT id, scope, target_product_id, target_category_id, starts_at, ends_at, created_at, false FROM req
  WHERE id IN (SELECT id FROM ok)),
pairs AS (
  SELECT r.id, b.id AS bid, b.scope AS bscope, b.created_at AS bat FROM req r JOIN blockers b
    ON b.scope = 'CATEGORY' AND b.target_category_id = CASE WHEN r.scope = 'CATEGORY' THEN r.target_category_id ELSE r.pcat END
   AND b.starts_at < r.ends_at AND r.starts_at < b.ends_at
   AND (b.old OR b.created_at < r.created_at OR (b.created_at = r.created_at AND b.id < r.id))
  UNION ALL
  SELECT r.id, b.id, b.scope, b.created_at FROM req r JOIN blockers b
    ON b.scope = 'PRODUCT' AND r.scope = 'PRODUCT' AND b.target_product_id = r.target_product_id
   AND b.starts_at < r.ends_at AND r.starts_at < b.ends_at
   AND (b.old OR b.created_at < r.created_at OR (b.created_at = r.created_at AND b.id < r.id))),
firsts AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY bat, bid) AS rn FROM pairs)
SELECT r.id, r.scope, r.id IN (SELECT id FROM ok) AS admitted,
  CASE WHEN r.id IN (SELECT id FROM ok) THEN NULL WHEN f.bscope = 'PRODUCT' THEN '{rules.REASON_PRODUCT}'
       WHEN f.bscope = 'CATEGORY' THEN '{rules.REASON_CATEGORY}' END AS reason,
  CASE WHEN r.id IN (SELECT id FROM ok) THEN NULL ELSE f.bid END AS conflicting_promotion_id
FROM req r LEFT JOIN firsts f ON f.id = r.id AND f.rn = 1"""


# The twin of the ``admit_promotions`` query, one recursive fold per scope.
ORACLE["admit_promotions"] = ADMIT_SQL
