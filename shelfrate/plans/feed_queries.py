"""Feed ETL queries: validation, pricing rules, ledger, categories, upsert,
chunk statistics, batch registration and completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfrate.functions.text import deterministic_uuid
from shelfrate.operators import feed as fd
from shelfrate.operators import ledger
from shelfrate.operators.catalog import batch_view
from shelfrate.plans.catalog import iso_sql, register
from shelfrate.plans.sqltext import (AS_OF_SQL, FEED_CTE, PRODUCTS_CTE, PROMOTIONS_CTE, VALIDATED_CTE,
                                     WINNER_CTES, ctes, price_sql, uuid_sql)
from shelfrate.sources import driver_tables as dt

# The driver feed is registered as one batch of this vendor and file.
FEED_VENDOR = "vendor-sf"
FEED_FILE = "part.csv"
FEED_BATCH_SQL = uuid_sql("batch", f"'{FEED_VENDOR}/{FEED_FILE}'")

FEED = ctes(FEED_CTE, VALIDATED_CTE)


def _batch_id():
    return ledger.batch_id(F.lit(FEED_VENDOR), F.lit(FEED_FILE))


def _validated(spark, sf_dir):
    return fd.validate(dt.feed(spark, sf_dir))


@register("feed_validate", FEED + "SELECT row_index, row_key, status, error_message FROM checked")
def feed_validate(spark, sf_dir):
    """V1-V4: every feed row OK or FAILED with all its issues."""
    return _validated(spark, sf_dir).select("row_index", "row_key", "status", "error_message")


@register("feed_price_rules", FEED + """
SELECT row_index, sku, base_price_norm AS base_price, stock_qty AS stock_quantity
FROM checked WHERE status = 'OK'""")
def feed_price_rules(spark, sf_dir):
    """Normalised OK rows, margin floor (cost x 1.10) and 2 decimals."""
    v = _validated(spark, sf_dir).filter(F.col("status") == "OK")
    return v.select("row_index", "sku", F.col("base_price_norm").alias("base_price"),
                    F.col("stock_qty").alias("stock_quantity"))


@register("feed_row_results", FEED + f"""
SELECT batch_id, row_key, status, error_message FROM (
  SELECT {FEED_BATCH_SQL} AS batch_id, row_key, status, NULLIF(error_message, '') AS error_message,
         row_number() OVER (PARTITION BY row_key ORDER BY row_index DESC) AS rn
  FROM checked) t WHERE rn = 1""")
def feed_row_results(spark, sf_dir):
    """The row ledger of the batch, later row wins per row key."""
    return fd.row_results(_validated(spark, sf_dir), _batch_id())


CATS_SQL = FEED + f""",
cats AS (SELECT DISTINCT p_brand AS name, p_brand AS id FROM part),
names AS (SELECT DISTINCT category_name AS name FROM checked WHERE status = 'OK'),
resolved AS (
  SELECT n.name, coalesce(c.id, {uuid_sql('category', 'n.name')}) AS id, c.id IS NULL AS is_new
  FROM names n LEFT JOIN cats c ON n.name = c.name)
"""


@register("feed_new_categories", CATS_SQL + "SELECT name, id, is_new FROM resolved")
def feed_new_categories(spark, sf_dir):
    """Category name -> id for the OK rows; missing names get new ids."""
    ok = _validated(spark, sf_dir).filter(F.col("status") == "OK")
    return fd.resolve_categories(ok, dt.categories(spark, sf_dir))


def _upsert_sql(update_effective: bool) -> str:
    eff_upd = (price_sql("inc.base_price_norm", "held.discount_type", "held.discount_value")
               if update_effective else "cur.effective_price")
    return (CATS_SQL.replace("WITH ", "WITH " + PRODUCTS_CTE + ",\n" + PROMOTIONS_CTE + ",\n", 1)
            + ", " + WINNER_CTES + f""",
inc AS (SELECT t.sku, t.name, r.id AS category_id, t.base_price_norm, t.stock_qty FROM (
          SELECT *, row_number() OVER (PARTITION BY sku ORDER BY row_index DESC) AS rn
          FROM checked WHERE status = 'OK') t
        LEFT JOIN resolved r ON t.category_name = r.name WHERE rn = 1),
cur AS (SELECT CAST(id AS VARCHAR) AS id, sku, name, CAST(category_id AS VARCHAR) AS category_id,
               base_price, stock_quantity, winner_id AS active_promotion_id, effective_price FROM state),
held AS (SELECT id, discount_type, discount_value FROM promotions
         WHERE status = 'ACTIVE' AND starts_at <= {AS_OF_SQL} AND {AS_OF_SQL} < ends_at)
SELECT CASE WHEN cur.sku IS NULL THEN {uuid_sql('product', 'inc.sku')} ELSE cur.id END AS id,
       coalesce(cur.sku, inc.sku) AS sku,
       CASE WHEN inc.sku IS NOT NULL THEN inc.name ELSE cur.name END AS name,
       CASE WHEN inc.sku IS NOT NULL THEN inc.category_id ELSE cur.category_id END AS category_id,
       CASE WHEN inc.sku IS NOT NULL THEN inc.base_price_norm ELSE cur.base_price END AS base_price,
       CASE WHEN inc.sku IS NOT NULL THEN inc.stock_qty ELSE cur.stock_quantity END AS stock_quantity,
       CASE WHEN cur.sku IS NULL THEN NULL ELSE cur.active_promotion_id END AS active_promotion_id,
       CAST(CASE WHEN cur.sku IS NULL THEN inc.base_price_norm
                 WHEN inc.sku IS NOT NULL THEN {eff_upd}
                 ELSE cur.effective_price END AS DECIMAL(12,2)) AS effective_price,
       CASE WHEN cur.sku IS NULL THEN 'INSERT' WHEN inc.sku IS NOT NULL THEN 'UPDATE' ELSE 'NONE' END
         AS change
FROM cur FULL OUTER JOIN inc ON cur.sku = inc.sku
LEFT JOIN held ON cur.active_promotion_id = held.id""")


def _upsert(spark, sf_dir, update_effective: bool):
    from shelfrate.plans.pricing_queries import _state
    state = _state(spark, sf_dir)
    ok = _validated(spark, sf_dir).filter(F.col("status") == "OK")
    cats = fd.resolve_categories(ok, dt.categories(spark, sf_dir))
    return fd.upsert_products(state, ok, cats, dt.promotions(spark, sf_dir), dt.as_of_lit(),
                              update_effective=update_effective)


@register("feed_upsert_products", _upsert_sql(True))
def feed_upsert_products(spark, sf_dir):
    """Upsert the OK rows by sku into the priced snapshot."""
    return _upsert(spark, sf_dir, True)


@register("seed_upsert", _upsert_sql(False))
def seed_upsert(spark, sf_dir):
    """Seed-style upsert: updates keep the stored effective price."""
    return _upsert(spark, sf_dir, False)


@register("feed_chunk_stats", FEED + """
SELECT CAST(floor(row_index / 500) AS BIGINT) AS chunk_index, CAST(count(*) AS BIGINT) AS rows,
       CAST(count(*) FILTER (WHERE status = 'OK') AS BIGINT) AS ok_rows,
       CAST(count(*) FILTER (WHERE status = 'FAILED') AS BIGINT) AS failed_rows
FROM checked GROUP BY 1""")
def feed_chunk_stats(spark, sf_dir):
    """Rows, OK and FAILED per chunk of 500."""
    return fd.chunk_stats(_validated(spark, sf_dir), fd.DEFAULT_CHUNK_SIZE)


@register("feed_totals", FEED + """
SELECT CAST(count(*) AS BIGINT) AS total_rows, CAST(ceil(count(*) / 500) AS BIGINT) AS chunk_count
FROM checked""")
def feed_totals(spark, sf_dir):
    """S3: total rows and chunk count of the feed."""
    return fd.feed_totals(_validated(spark, sf_dir), fd.DEFAULT_CHUNK_SIZE)


@register("feed_batch_totals", FEED + f"""
SELECT {FEED_BATCH_SQL} AS batch_id, CAST(count(*) AS BIGINT) AS total_rows,
       CAST(count(*) FILTER (WHERE status = 'OK') AS BIGINT) AS processed_rows,
       CAST(count(*) FILTER (WHERE status = 'FAILED') AS BIGINT) AS failed_rows
FROM checked""")
def feed_batch_totals(spark, sf_dir):
    """A3: processed / failed of the batch, derived from the row results."""
    return fd.batch_totals(_validated(spark, sf_dir), _batch_id())


ARRIVALS_CTE = """arrivals AS (
  SELECT 'vendor-' || CAST(o_custkey % 100 AS VARCHAR) AS vendor_id,
         CASE WHEN o_orderkey % 997 = 0 THEN '../etc/passwd.csv'
              ELSE 'feed-' || strftime(o_orderdate, '%Y-%m') || '.csv' END AS source_file,
         o_orderkey AS arrival
  FROM orders)"""


def _arrivals(spark, sf_dir):
    o = dt.read_table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("vendor-"), (F.col("o_custkey") % 100).cast("string")).alias("vendor_id"),
        F.when(F.col("o_orderkey") % 997 == 0, F.lit("../etc/passwd.csv"))
         .otherwise(F.concat(F.lit("feed-"), F.date_format("o_orderdate", "yyyy-MM"), F.lit(".csv")))
         .alias("source_file"),
        F.col("o_orderkey").alias("arrival"))


REGISTER_SQL = ctes(ARRIVALS_CTE) + f""",
checked_arr AS (
  SELECT *, CASE WHEN length(source_file) > 255
                   THEN 'sourceFile: String must contain at most 255 character(s)'
                 WHEN NOT regexp_matches(source_file, '^[A-Za-z0-9._-]+\\.csv\\z', 'i')
                   THEN 'sourceFile: sourceFile must be a *.csv filename, no path components' END AS error
  FROM arrivals),
firsts AS (SELECT vendor_id, source_file, min(arrival) AS fa FROM checked_arr WHERE error IS NULL
           GROUP BY vendor_id, source_file),
decisions AS (
  SELECT a.vendor_id, a.source_file, a.arrival,
         {uuid_sql('batch', "a.vendor_id || '/' || a.source_file")} AS batch_id,
         CASE WHEN a.arrival = f.fa THEN 'CREATED' ELSE 'EXISTING' END AS decision,
         CAST(NULL AS VARCHAR) AS error
  FROM checked_arr a JOIN firsts f ON a.vendor_id = f.vendor_id AND a.source_file = f.source_file
  WHERE a.error IS NULL
  UNION ALL
  SELECT vendor_id, source_file, arrival, CAST(NULL AS VARCHAR), 'REJECTED', error
  FROM checked_arr WHERE error IS NOT NULL)
"""


@register("batch_register", REGISTER_SQL + "SELECT * FROM decisions")
def batch_register(spark, sf_dir):
    """One decision per file arrival (CREATED / EXISTING / REJECTED)."""
    return ledger.register_batches(_arrivals(spark, sf_dir), None, dt.as_of_lit())


@register("batch_completion", REGISTER_SQL.replace("WITH ", "WITH " + FEED_CTE + ",\n" + VALIDATED_CTE + ",\n", 1)
          + f""",
ledger AS (
  SELECT batch_id AS id, vendor_id, source_file FROM decisions WHERE decision = 'CREATED'
  UNION ALL
  SELECT {FEED_BATCH_SQL}, '{FEED_VENDOR}', '{FEED_FILE}'),
totals AS (
  SELECT {FEED_BATCH_SQL} AS batch_id, count(*) AS total_rows,
         count(*) FILTER (WHERE status = 'OK') AS processed_rows,
         count(*) FILTER (WHERE status = 'FAILED') AS failed_rows
  FROM checked)
SELECT l.id, l.vendor_id, l.source_file,
       CASE WHEN t.total_rows IS NOT NULL AND t.processed_rows + t.failed_rows >= t.total_rows
            THEN 'COMPLETED' ELSE 'PROCESSING' END AS status,
       CAST(t.total_rows AS BIGINT) AS total_rows,
       CAST(coalesce(t.processed_rows, 0) AS BIGINT) AS processed_rows,
       CAST(coalesce(t.failed_rows, 0) AS BIGINT) AS failed_rows,
       {iso_sql(AS_OF_SQL)} AS started_at,
       CASE WHEN t.total_rows IS NOT NULL AND t.processed_rows + t.failed_rows >= t.total_rows
            THEN {iso_sql(AS_OF_SQL)} END AS finished_at
FROM ledger l LEFT JOIN totals t ON l.id = t.batch_id""")
def batch_completion(spark, sf_dir):
    """The view of the ledger after the feed batch's counters are merged; a
    batch whose processed + failed reach its total is COMPLETED."""
    at = dt.as_of_lit()
    dec = ledger.register_batches(_arrivals(spark, sf_dir), None, at)
    created = ledger.new_batches(dec, at)
    feed_batch = created.sparkSession.range(1).select(
        _batch_id().alias("id"), F.lit(FEED_VENDOR).alias("vendor_id"), F.lit(FEED_FILE).alias("source_file"),
        F.lit("PROCESSING").alias("status"), F.lit(None).cast("int").alias("total_rows"),
        F.lit(0).alias("processed_rows"), F.lit(0).alias("failed_rows"), at.alias("started_at"),
        F.lit(None).cast("timestamp_ntz").alias("finished_at"))
    batches = created.withColumn("started_at", at).withColumn(
        "finished_at", F.lit(None).cast("timestamp_ntz")).unionByName(feed_batch)
    totals = fd.batch_totals(_validated(spark, sf_dir), _batch_id())
    done = ledger.complete_batches(batches, totals, at)
    return batch_view(done)


@register("batch_transitions", REGISTER_SQL + """,
ends AS (SELECT CASE WHEN vendor_id = 'vendor-7' THEN 'failed' ELSE 'completed' END AS transition
  FROM decisions WHERE decision = 'CREATED' AND arrival % 2 = 0)
SELECT transition, CAST(count(*) AS BIGINT) AS value FROM (
  SELECT CASE decision WHEN 'CREATED' THEN 'started' WHEN 'EXISTING' THEN 'deduplicated'
                       ELSE 'rejected' END AS transition FROM decisions
  UNION ALL SELECT transition FROM ends) t GROUP BY 1""")
def batch_transitions(spark, sf_dir):
    """Batch transition counter over the registration decisions and the
    ledger after every second batch ended, those of one vendor by failure."""
    from shelfrate.operators import rollup
    at = dt.as_of_lit()
    dec = ledger.register_batches(_arrivals(spark, sf_dir), None, at)
    ended = ledger.new_batches(dec.filter(F.col("arrival") % 2 == 0), at)
    done = ledger.complete_batches(ended, ledger.with_empty_batches(
        ended.limit(0).select(F.col("id").alias("batch_id"), *[F.lit(0).cast("long").alias(c) for c in (
            "total_rows", "processed_rows", "failed_rows")]), ended.select(F.col("id").alias("batch_id"))), at)
    done = ledger.fail_batches(done, ended.filter(F.col("vendor_id") == "vendor-7").select("id"), at)
    return rollup.counter(ledger.transitions(dec, done), ["transition"])
