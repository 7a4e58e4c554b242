"""SQL text shared by the DuckDB oracle strings.

Only the raw driver tables are registered on the oracle side, so the
catalogue views (FIXTURES part B) are inlined as CTEs here. The expressions
are valid in both DuckDB and Spark SQL.
"""

AS_OF_SQL = "TIMESTAMP '1998-06-15 00:00:00'"

PRODUCTS_CTE = """products AS (
  SELECT p_partkey AS id,
         'SKU-' || CAST(p_partkey AS VARCHAR) AS sku,
         p_name AS name,
         p_brand AS category_id,
         CAST(p_retailprice AS DECIMAL(12,2)) AS base_price,
         p_size AS stock_quantity
  FROM part)"""

PROMOTIONS_CTE = """promotions AS (
  SELECT o_orderkey AS id,
         'promo-' || CAST(o_orderkey AS VARCHAR) AS name,
         CASE WHEN o_orderkey % 3 = 0 THEN 'FIXED_AMOUNT' ELSE 'PERCENTAGE' END AS discount_type,
         CAST(1 + o_orderkey % 60 AS DECIMAL(12,2)) AS discount_value,
         CASE WHEN o_orderkey % 50 = 0 THEN 'CATEGORY' ELSE 'PRODUCT' END AS scope,
         CASE WHEN o_orderkey % 50 <> 0 THEN o_custkey END AS target_product_id,
         CASE WHEN o_orderkey % 50 = 0
              THEN 'Brand#' || CAST(1 + CAST(floor(o_orderkey / 50) AS BIGINT) % 25 AS VARCHAR) END
           AS target_category_id,
         o_orderdate AS starts_at,
         CASE WHEN o_orderkey % 50 = 0 THEN o_orderdate + INTERVAL 90 DAY
              ELSE o_orderdate + INTERVAL 30 DAY END AS ends_at,
         CASE WHEN o_orderkey % 11 = 0 THEN 'CANCELLED'
              WHEN o_orderkey % 13 = 0 THEN 'EXPIRED'
              WHEN o_orderkey % 2 = 0 THEN 'SCHEDULED'
              ELSE 'ACTIVE' END AS status,
         o_orderdate AS created_at
  FROM orders)"""

FEED_CTE = """feed AS (
  SELECT p_partkey AS row_index,
         CASE WHEN p_partkey % 97 = 0 THEN ''
              ELSE 'SKU-' || CAST(CASE WHEN p_partkey % 71 = 0 THEN p_partkey + 1
                                       ELSE p_partkey + p_partkey % 2 * 1000000 END AS VARCHAR) END AS sku,
         p_name AS name,
         CASE WHEN p_partkey % 61 = 0 THEN 'New#' || CAST(p_partkey % 5 AS VARCHAR)
              ELSE p_brand END AS category_name,
         CASE WHEN p_partkey % 89 = 0 THEN 'not-a-number'
              ELSE CAST(CAST(p_retailprice AS DECIMAL(12,3)) + CAST(0.005 AS DECIMAL(4,3)) AS VARCHAR) END
           AS base_price,
         CASE WHEN p_partkey % 3 = 0
              THEN CAST(CAST(p_retailprice AS DECIMAL(12,2)) * CAST(0.95 AS DECIMAL(3,2)) AS VARCHAR)
              ELSE '' END AS vendor_cost,
         CASE WHEN p_partkey % 83 = 0 THEN '-1' ELSE CAST(p_size AS VARCHAR) END AS stock_quantity
  FROM part)"""

LIVE_PRED = ("status IN ('ACTIVE','SCHEDULED') AND starts_at <= {t} AND {t} < ends_at")


def live(t: str = AS_OF_SQL) -> str:
    return LIVE_PRED.format(t=t)


def price_sql(base: str, dtype: str, dvalue: str) -> str:
    """X5 in SQL: same decimal arithmetic as the Column version."""
    return (f"CAST(CASE WHEN {dtype} IS NULL THEN round({base}, 2) "
            f"ELSE greatest(round(CASE WHEN {dtype} = 'PERCENTAGE' THEN {base} * (100 - {dvalue}) * 0.01 "
            f"WHEN {dtype} = 'FIXED_AMOUNT' THEN {base} - {dvalue} END, 2), 0) END AS DECIMAL(12,2))")


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


WINNER_CTES = """live AS (SELECT * FROM promotions WHERE {live}),
pw AS (SELECT target_product_id, id, discount_type, discount_value FROM (
  SELECT *, row_number() OVER (PARTITION BY target_product_id
                               ORDER BY created_at DESC NULLS LAST, id DESC) AS rn
  FROM live WHERE scope = 'PRODUCT') t WHERE rn = 1),
cw AS (SELECT target_category_id, id, discount_type, discount_value FROM (
  SELECT *, row_number() OVER (PARTITION BY target_category_id
                               ORDER BY created_at DESC NULLS LAST, id DESC) AS rn
  FROM live WHERE scope = 'CATEGORY') t WHERE rn = 1),
priced AS (
  SELECT p.id, p.sku, p.name, p.category_id, p.base_price, p.stock_quantity,
         CASE WHEN pw.id IS NOT NULL THEN pw.id ELSE cw.id END AS winner_id,
         CASE WHEN pw.id IS NOT NULL THEN 'PRODUCT' WHEN cw.id IS NOT NULL THEN 'CATEGORY' END AS winner_scope,
         CASE WHEN pw.id IS NOT NULL THEN pw.discount_type ELSE cw.discount_type END AS discount_type,
         CASE WHEN pw.id IS NOT NULL THEN pw.discount_value ELSE cw.discount_value END AS discount_value
  FROM products p
  LEFT JOIN pw ON p.id = pw.target_product_id
  LEFT JOIN cw ON p.category_id = cw.target_category_id),
state AS (
  SELECT *, {price} AS effective_price FROM priced)""".format(
    live=live(), price=price_sql("base_price", "discount_type", "discount_value"))


def uuid_sql(namespace: str, key: str) -> str:
    """X15 in SQL (same text as ``functions.text.deterministic_uuid``)."""
    h = f"md5('{namespace}:' || CAST({key} AS VARCHAR))"
    return (f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' "
            f"|| substr({h}, 17, 4) || '-' || substr({h}, 21, 12))")


NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\z"
DECIMAL_TEXT = r"^\d+(\.\d+)?\z"


def _len_sql(col: str, lo: int, hi: int) -> str:
    return (f"CASE WHEN {col} IS NULL THEN '{col}: Required' "
            f"WHEN length({col}) < {lo} THEN '{col}: String must contain at least {lo} character(s)' "
            f"WHEN length({col}) > {hi} THEN '{col}: String must contain at most {hi} character(s)' END")


VALIDATED_CTE = f"""stocknum AS (
  SELECT *, CASE WHEN stock_quantity IS NULL THEN NULL
                 WHEN regexp_matches(stock_quantity, '^\\s*\\z') THEN CAST(0 AS DOUBLE)
                 WHEN regexp_matches(stock_quantity, '{NUMBER_TEXT}')
                   THEN TRY_CAST(trim(stock_quantity) AS DOUBLE) END AS num,
            TRY_CAST(base_price AS DECIMAL(28,16)) AS bnum,
            CASE WHEN vendor_cost <> '' THEN TRY_CAST(vendor_cost AS DECIMAL(28,16)) END AS cnum
  FROM feed),
issues AS (
  SELECT *, NULLIF(concat_ws('; ',
      {_len_sql('sku', 1, 64)},
      {_len_sql('name', 1, 255)},
      {_len_sql('category_name', 1, 255)},
      CASE WHEN base_price IS NULL THEN 'base_price: Required'
           WHEN NOT regexp_matches(base_price, '{DECIMAL_TEXT}') THEN 'base_price: expected a non-negative decimal' END,
      CASE WHEN vendor_cost IS NOT NULL AND vendor_cost <> '' AND NOT regexp_matches(vendor_cost, '{DECIMAL_TEXT}')
           THEN 'vendor_cost: expected a non-negative decimal' END,
      CASE WHEN num IS NULL THEN 'stock_quantity: Expected number, received nan' END,
      CASE WHEN num IS NOT NULL AND num <> floor(num) THEN 'stock_quantity: Expected integer, received float' END,
      CASE WHEN num IS NOT NULL AND num < 0 THEN 'stock_quantity: Number must be greater than or equal to 0' END
    ), '') AS verr,
    TRY_CAST(round(CASE WHEN cnum IS NOT NULL AND bnum < cnum * 1.1 THEN cnum * 1.1 ELSE bnum END, 2)
             AS DECIMAL(12,2)) AS priced
  FROM stocknum),
validated AS (
  SELECT row_index, sku, name, category_name,
         coalesce(NULLIF(sku, ''), 'unknown-' || CAST(row_index AS VARCHAR)) AS row_key,
         coalesce(verr, CASE WHEN cnum < 0 THEN 'VENDOR_COST_NEGATIVE: vendor_cost must be >= 0'
                             WHEN priced IS NULL THEN 'base_price: value out of range'
                             WHEN TRY_CAST(num AS INTEGER) IS NULL THEN 'stock_quantity: value out of range' END)
           AS error_message,
         priced, TRY_CAST(num AS INTEGER) AS stock_qty
  FROM issues),
checked AS (
  SELECT *, CASE WHEN error_message IS NULL THEN 'OK' ELSE 'FAILED' END AS status,
         CASE WHEN error_message IS NULL THEN priced END AS base_price_norm
  FROM validated)"""
