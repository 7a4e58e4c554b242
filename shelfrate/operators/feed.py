"""Vendor feed ETL (Scenario A): validate, price, resolve categories, upsert.

V1-V4, X6, X11-X13, M1, M2, M13, A1-A4, M17 of the survey. Every rule is a
Column expression over the raw text feed, so a feed of any size is one
narrow pass plus the keyed shuffles the upserts need (``sku``,
``category_name``, ``(batch_id, row_key)``). Nothing is dropped silently:
each row ends up OK or FAILED with its error text.

A raw feed carries ``row_index`` (feed order, 0-based) and the text
columns of ``schemas.FEED_COLUMNS``; a column absent from the file's header
is NULL (``Required``), a present but empty cell is ''.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfrate.functions.money import effective_price, margin_floor_price
from shelfrate.functions.text import deterministic_uuid
from shelfrate.operators import rules
from shelfrate.plans.joins import join_small, measure, persist_for_job

# Fixed values (must equal the reference's): text limits, the decimal-text
# pattern and its message, the chunk size default, pricing-rule error.
SKU_MAX = 64
TEXT_MAX = 255
DECIMAL_TEXT = r"^\d+(\.\d+)?\z"
DECIMAL_MSG = "expected a non-negative decimal"
DEFAULT_CHUNK_SIZE = 500
VENDOR_COST_NEGATIVE = "VENDOR_COST_NEGATIVE: vendor_cost must be >= 0"
MALFORMED_ROW = "row: number of cells does not match the header"

# Text a JavaScript Number() turns into a finite number: blank, or a
# decimal with optional sign, fraction and exponent (hex is not accepted).
_NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\z"
_BLANK = r"^\s*\z"


def _len_issues(col: str, lo: int, hi: int) -> list[Column]:
    c = F.col(col)
    return [
        F.when(c.isNull(), F.lit(f"{col}: Required"))
         .when(F.length(c) < lo, F.lit(f"{col}: String must contain at least {lo} character(s)"))
         .when(F.length(c) > hi, F.lit(f"{col}: String must contain at most {hi} character(s)")),
    ]


def _decimal_issue(col: str, optional: bool) -> Column:
    c = F.col(col)
    bad = ~F.regexp_like(c, F.lit(DECIMAL_TEXT))
    if optional:  # '' -> absent (X12)
        return F.when(c.isNotNull() & (c != "") & bad, F.lit(f"{col}: {DECIMAL_MSG}"))
    return F.when(c.isNull(), F.lit(f"{col}: Required")).when(bad, F.lit(f"{col}: {DECIMAL_MSG}"))


def stock_number(col: str = "stock_quantity") -> Column:
    """JS-style numeric coercion of the stock text (blank -> 0), as double."""
    c = F.col(col)
    return (F.when(c.isNull(), F.lit(None).cast("double"))
             .when(F.regexp_like(c, F.lit(_BLANK)), F.lit(0.0))
             .when(F.regexp_like(c, F.lit(_NUMBER_TEXT)), F.trim(c).try_cast("double")))


def _stock_issues(n: Column) -> list[Column]:
    nan = n.isNull()
    return [
        F.when(nan, F.lit("stock_quantity: Expected number, received nan")),
        F.when(~nan & (n != F.floor(n)), F.lit("stock_quantity: Expected integer, received float")),
        F.when(~nan & (n < 0), F.lit("stock_quantity: Number must be greater than or equal to 0")),
    ]


def validation_errors(stock: Column | None = None) -> Column:
    """V1 + V2: every issue of the row as ``path: message`` joined by '; '
    (schema order), NULL when the row is valid. ``stock`` is the coerced
    stock number (``stock_number()`` when not given)."""
    issues = (_len_issues("sku", 1, SKU_MAX) + _len_issues("name", 1, TEXT_MAX)
              + _len_issues("category_name", 1, TEXT_MAX)
              + [_decimal_issue("base_price", False), _decimal_issue("vendor_cost", True)]
              + _stock_issues(stock if stock is not None else stock_number()))
    joined = F.array_join(F.filter(F.array(*issues), lambda x: x.isNotNull()), "; ")
    return F.when(joined == "", F.lit(None)).otherwise(joined)


def row_key(sku: str = "sku", row_index: str = "row_index") -> Column:
    """X11: sku when non-empty, else a deterministic ``unknown-<row_index>``."""
    return F.coalesce(F.nullif(F.col(sku), F.lit("")),
                      F.concat(F.lit("unknown-"), F.col(row_index).cast("string")))


def validate(raw: DataFrame) -> DataFrame:
    """V1-V4 + X6: one row per feed row with status OK/FAILED.

    Adds ``row_key, status, error_message`` and for OK rows the normalised
    ``base_price_norm`` (decimal(12,2), margin floor applied) and
    ``stock_qty`` (int).
    """
    # Each derived value is its own column so the expressions are evaluated
    # once per row (no duplicated subtrees in the generated code).
    v = (raw.withColumn("row_key", row_key())
            .withColumn("__stock", stock_number())
            .withColumn("__base", F.col("base_price").try_cast("decimal(28,16)"))
            .withColumn("__cost", F.when(F.col("vendor_cost") != "",
                                         F.col("vendor_cost").try_cast("decimal(28,16)"))))
    v = (v.withColumn("__verr", validation_errors(F.col("__stock")))
          .withColumn("__priced", margin_floor_price("__base", "__cost").try_cast("decimal(12,2)"))
          .withColumn("__stock_int", F.col("__stock").try_cast("int")))
    # V4 is only reachable on typed input (the regex forbids '-'), kept for parity.
    perr = (F.when(F.col("__cost") < 0, F.lit(VENDOR_COST_NEGATIVE))
             .when(F.col("__priced").isNull(), F.lit("base_price: value out of range"))  # Q9
             .when(F.col("__stock_int").isNull(), F.lit("stock_quantity: value out of range")))
    err = F.coalesce(F.col("__verr"), perr)
    if "_corrupt_record" in raw.columns:  # Q10: wrong cell count -> FAILED
        err = F.when(F.col("_corrupt_record").isNotNull(), F.lit(MALFORMED_ROW)).otherwise(err)
    v = v.withColumn("error_message", err)
    ok = F.col("error_message").isNull()
    return (v.withColumn("status", F.when(ok, F.lit("OK")).otherwise(F.lit("FAILED")))
             .withColumn("base_price_norm", F.when(ok, F.col("__priced")))
             .withColumn("stock_qty", F.when(ok, F.col("__stock_int")))
             .drop("__verr", "__stock", "__base", "__cost", "__priced", "__stock_int"))


def chunk_index(n: int = DEFAULT_CHUNK_SIZE, row_index: str = "row_index") -> Column:
    """0-based chunk of a row (the last chunk may be partial)."""
    if n <= 0:
        raise ValueError("chunkSize must be positive")
    return F.floor(F.col(row_index) / F.lit(n)).cast("bigint")


# Feed order over several files: arrival of the file, its path, place in the file.
FEED_ORDER = ("arrival", "source_file", "row_index")


def latest_per_key(df: DataFrame, key: str) -> DataFrame:
    """The later row wins per key (top-1 with a partial, map-side limit); of several files the later one."""
    return rules.top1_per_key(df, key, [F.col(c).desc_nulls_last() for c in FEED_ORDER if c in df.columns])


def resolve_categories(ok_rows: DataFrame, categories: DataFrame) -> DataFrame:
    """M2 (A1 + J7): name -> id for every category named by the OK rows;
    names not yet present get a new deterministic id. Returns
    ``name, id, is_new``."""
    names = ok_rows.select(F.col("category_name").alias("name")).distinct()  # A1
    known = categories.select("name", F.col("id").cast("string").alias("id"))
    found = names.join(known, "name", "left")
    return found.select(
        "name",
        F.coalesce(F.col("id"), deterministic_uuid(F.lit("category"), F.col("name"))).alias("id"),
        F.col("id").isNull().alias("is_new"))


def upsert_products(products: DataFrame, ok_rows: DataFrame, category_ids: DataFrame,
                    promotions: DataFrame, at: Column,
                    update_effective: bool = True) -> DataFrame:
    """M1 (J5 J9 F6): insert-or-update products by sku.

    * insert: new deterministic id, effective = base, no promotion;
    * update: name, category, base, stock from the feed; id and
      ``active_promotion_id`` kept; effective = price under the held
      promotion when it is ACTIVE and inside its window at ``at`` (F6),
      else the new base (the id stays set: Q3);
    * untouched products pass through.

    With ``update_effective=False`` (M14, seed) updates keep the stored
    effective price. Output adds ``change`` in INSERT/UPDATE/NONE. Time
    columns of ``products`` (created_at, updated_at,
    effective_price_updated_at) come out stamped with ``at`` on the rows
    that the feed inserts or updates, and as they were on all others.
    """
    inc, small_feed = incoming_products(ok_rows, category_ids)
    return upsert_incoming(products, inc, small_feed, promotions, at, update_effective)


def upsert_incoming(products: DataFrame, inc: DataFrame, small_feed: bool, promotions: DataFrame, at: Column,
                    update_effective: bool = True, whole: bool = True) -> DataFrame:
    """M1 for the feed that ``incoming_products`` gave. ``whole=False``: ``products`` holds only rows of its skus, as
    a small feed's may be looked up, so there are no untouched ones; their effective price is replaced as well."""
    cur, held = _catalogue(products), _held(promotions, at)
    if not whole:
        # The feed's row replaces all other columns, so they are not read.
        cur = cur.select(*[F.col(c) if c in KEPT else F.lit(None).cast(t).alias(c) for c, t in cur.dtypes])
    if small_feed:
        j = _changed_small_feed(cur, inc, held)
        if whole:
            untouched = cur.join(F.broadcast(inc.select(F.col("__sku").alias("__s"))),
                                 cur["sku"] == F.col("__s"), "left_anti")
            j = j.unionByName(_filled(untouched, j.schema))
    else:
        # Feed too large to broadcast: one full outer join on sku.
        j = cur.join(inc, cur["sku"] == inc["__sku"], "full_outer")
        j = join_small(j, held, j["active_promotion_id"] == held["__hid"], "left",
                       big_key="active_promotion_id")
    return _upserted(j, at, update_effective)


def incoming_products(ok_rows: DataFrame, category_ids: DataFrame,
                      few_categories: bool | None = None, few_rows: int = 0) -> tuple[DataFrame, bool]:
    """The row of each sku that counts, with its category's id, and whether these are few enough to broadcast.
    ``few_categories``: what ``measure`` said of ``category_ids``, if it was asked before; ``few_rows``: the number of
    ``ok_rows``, if it is known to be within ``surely_small``, so that nothing need be measured."""
    if few_rows:  # a cached frame keeps all partitions of its last shuffle, most of them empty for a small feed
        ok_rows = ok_rows.repartition(row_tasks(few_rows), "sku")
    incoming = latest_per_key(ok_rows, "sku")  # W4: later row wins (Q6)
    cats = category_ids.select(F.col("name").alias("__cname"), F.col("id").alias("__cid"))
    incoming = join_small(incoming, cats, incoming["category_name"] == cats["__cname"], "left", fits=few_categories)
    inc = incoming.select(
        F.col("sku").alias("__sku"), F.col("name").alias("__name"),
        F.col("__cid").alias("__category_id"), F.col("base_price_norm").alias("__base"),
        F.col("stock_qty").alias("__stock"))
    return (persist_for_job(inc), True) if few_rows else measure(inc, FEED_BROADCAST_ROWS, FEED_BROADCAST_BYTES)


# What an update keeps of a product, when it sets the effective price.
KEPT = ("id", "sku", "active_promotion_id", "created_at")
STAMPS = ("effective_price_updated_at", "created_at", "updated_at")


def _catalogue(products: DataFrame) -> DataFrame:
    return products.select(F.col("id").cast("string").alias("id"), "sku", "name",
                           F.col("category_id").cast("string").alias("category_id"),
                           "base_price", "stock_quantity", "active_promotion_id", "effective_price",
                           *[c for c in STAMPS if c in products.columns])


def _held(promotions: DataFrame, at: Column) -> DataFrame:
    """The promotions that a product may hold, only when ACTIVE and inside their window."""
    kinds = {promotions.schema[c].dataType for c in ("starts_at", "ends_at")}
    if len(kinds) == 1:
        at = at.cast(kinds.pop())  # of the columns' type, so that files and pages outside the window are not read
    return promotions.filter(rules.is_live_strict(at)).select(
        F.col("id").alias("__hid"), F.col("discount_type").alias("__htype"),
        F.col("discount_value").alias("__hvalue"))


def _upserted(j: DataFrame, at: Column, update_effective: bool) -> DataFrame:
    """The catalogue's rows after the upsert, from each one beside the feed's row of its sku and its promotion."""
    is_new = F.col("sku").isNull()
    is_upd = F.col("sku").isNotNull() & F.col("__sku").isNotNull()
    new_eff = effective_price(F.col("__base"), F.col("__htype"), F.col("__hvalue"))
    eff = (F.when(is_new, F.col("__base"))
            .when(is_upd, new_eff if update_effective else F.col("effective_price"))
            .otherwise(F.col("effective_price")))
    return j.select(
        F.when(is_new, deterministic_uuid(F.lit("product"), F.col("__sku"))).otherwise(F.col("id")).alias("id"),
        F.coalesce(F.col("sku"), F.col("__sku")).alias("sku"),
        F.when(F.col("__sku").isNotNull(), F.col("__name")).otherwise(F.col("name")).alias("name"),
        F.when(F.col("__sku").isNotNull(), F.col("__category_id")).otherwise(F.col("category_id")).alias("category_id"),
        F.when(F.col("__sku").isNotNull(), F.col("__base")).otherwise(F.col("base_price")).alias("base_price"),
        F.when(F.col("__sku").isNotNull(), F.col("__stock")).otherwise(F.col("stock_quantity")).alias("stock_quantity"),
        F.when(is_new, F.lit(None)).otherwise(F.col("active_promotion_id")).alias("active_promotion_id"),
        eff.cast("decimal(12,2)").alias("effective_price"),
        *[F.when(is_new if c == "created_at" or (c != "updated_at" and not update_effective) else is_new | is_upd,
                 at.cast("timestamp")).otherwise(F.col(c)).alias(c) for c in STAMPS if c in j.columns],
        F.when(is_new, F.lit("INSERT")).when(is_upd, F.lit("UPDATE")).otherwise(F.lit("NONE")).alias("change"),
    )


# Feeds up to this many distinct skus and bytes are broadcast, so the
# catalogue is not shuffled by an ingest of usual size.
FEED_BROADCAST_ROWS = 1_000_000
FEED_BROADCAST_BYTES = 192 * 2**20
# A valid row's texts are bounded, at four bytes a character; TASK_ROWS of them are held by one task.
ROW_BYTES = 4 * (SKU_MAX + 2 * TEXT_MAX) + 128
TASK_ROWS = 10_000


def surely_small(ok_rows: int) -> bool:
    """Whether so many valid rows can be broadcast, however long their texts are."""
    return ok_rows <= FEED_BROADCAST_ROWS and ok_rows * ROW_BYTES <= FEED_BROADCAST_BYTES


def row_tasks(ok_rows: int) -> int:
    return 1 + ok_rows // TASK_ROWS


def _changed_small_feed(cur: DataFrame, inc: DataFrame, held: DataFrame) -> DataFrame:
    """Upsert plan for a feed of measured, bounded size: the rows that it updates and inserts.

    The catalogue is read in a narrow pass against the broadcast feed; only the
    matched rows — at most one per feed row — meet the held promotions and
    only the feed's skus are compared for inserts. No catalogue shuffle.
    """
    # At most one catalogue row per feed sku (sku is unique in the catalogue),
    # so ``matched`` is bounded by the measured feed; cached because it is
    # read three times below.
    matched = persist_for_job(cur.join(F.broadcast(inc), cur["sku"] == inc["__sku"], "inner"))
    m_skus = matched.select(F.col("sku").alias("__m"))
    inserts = inc.join(m_skus, inc["__sku"] == m_skus["__m"], "left_anti")
    ids = matched.select(F.col("active_promotion_id").alias("__need")).filter(
        F.col("__need").isNotNull()).distinct()
    held_needed = held.join(F.broadcast(ids), held["__hid"] == ids["__need"], "left_semi")
    # |held_needed| <= |distinct held ids of matched| <= |feed|: bounded by
    # the measurement above, so it is broadcast without another count.
    updates = matched.join(F.broadcast(held_needed), matched["active_promotion_id"] == held_needed["__hid"],
                           "left")
    return updates.unionByName(_filled(inserts, updates.schema))


def _filled(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` with the columns of ``schema``, NULL where it has none."""
    return df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
                       for f in schema.fields])


def row_results(validated: DataFrame, batch_id: Column) -> DataFrame:
    """M13 rows: (batch_id, row_key, status, error_message), later row wins
    per (batch_id, row_key); '' and NULL errors both become NULL."""
    r = validated.select(batch_id.alias("batch_id"), "row_key", "status",
                         F.nullif(F.col("error_message"), F.lit("")).alias("error_message"),
                         "row_index")
    return rules.top1_per_key(r.withColumn("__k", F.concat_ws("\u0001", F.col("batch_id").cast("string"), "row_key")),
                              "__k", [F.col("row_index").desc()]).drop("__k", "row_index")


def upsert_row_results(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """ON CONFLICT (batch_id, row_key) DO UPDATE — fresh rows replace."""
    keep = existing.join(fresh.select("batch_id", "row_key"), ["batch_id", "row_key"], "left_anti")
    return keep.unionByName(fresh.select(*existing.columns))


def chunk_stats(validated: DataFrame, n: int = DEFAULT_CHUNK_SIZE) -> DataFrame:
    """S2 + A2: per chunk: rows, OK and FAILED counts."""
    return (validated.withColumn("chunk_index", chunk_index(n))
            .groupBy("chunk_index")
            .agg(F.count(F.lit(1)).alias("rows"),
                 F.count_if(F.col("status") == "OK").alias("ok_rows"),
                 F.count_if(F.col("status") == "FAILED").alias("failed_rows")))


def feed_totals(validated: DataFrame, n: int = DEFAULT_CHUNK_SIZE) -> DataFrame:
    """S3: {total_rows, chunk_count}; 0/0 for a header-only feed."""
    return validated.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows", F.ceil(F.col("total_rows") / F.lit(n)).cast("bigint").alias("chunk_count"))


def batch_totals(validated: DataFrame, batch_id: Column, *more: Column) -> DataFrame:
    """A3: processed / failed per batch, recomputed from the per-row results
    (one per feed row), so a retried chunk never double counts (Q8). ``more``
    are aggregates made in the same pass."""
    return (validated.withColumn("batch_id", batch_id).groupBy("batch_id")
            .agg(F.count(F.lit(1)).alias("total_rows"),
                 F.count_if(F.col("status") == "OK").alias("processed_rows"),
                 F.count_if(F.col("status") == "FAILED").alias("failed_rows"), *more))
