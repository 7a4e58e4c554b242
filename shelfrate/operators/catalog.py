"""Product catalogue: bulk create/update, listings, keyset pages, views.

M8, M9, M14, L1-L5, P1-P4, F8-F10. Listings use ``orderBy().limit()``
(TakeOrderedAndProject: per-partition top-k, no global sort); the bulk
page numbering (L5) uses a distributed global row number rather than a
single-partition window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from shelfrate.functions.money import as_money, effective_price, format_money
from shelfrate.functions.text import decimal_sort_text, decode_cursor, encode_cursor, keyset_after
from shelfrate.operators import rules
from shelfrate.plans.joins import join_small
from shelfrate.plans.ordering import global_row_number

# Fixed values (must equal the reference's): page size default and bounds,
# sortable fields and directions.
DEFAULT_LIMIT = 20
MAX_LIMIT = 100
SORT_FIELDS = {"effective_price": "effective_price", "name": "name"}
DIRECTIONS = ("asc", "desc")
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def check_page_args(sort: str = "effective_price", direction: str = "asc",
                    limit: int = DEFAULT_LIMIT) -> None:
    """Argument checks of the list API."""
    if sort not in SORT_FIELDS:
        raise ValueError(f"sort must be one of {sorted(SORT_FIELDS)}")
    if direction not in DIRECTIONS:
        raise ValueError("direction must be asc or desc")
    if not isinstance(limit, int) or limit < 1 or limit > MAX_LIMIT:
        raise ValueError(f"limit must be an integer in 1..{MAX_LIMIT}")


def _order(sort_col: str, direction: str) -> list[Column]:
    if direction == "asc":
        return [F.col(sort_col).asc(), F.col("id").asc()]
    return [F.col(sort_col).desc(), F.col("id").desc()]


def sort_value_text(sort: str) -> Column:
    """Cursor text of the sort value: decimals without trailing zeros."""
    return decimal_sort_text("effective_price") if sort == "effective_price" else F.col("name")


def keyset_page(products: DataFrame, sort: str = "effective_price", direction: str = "asc",
                limit: int = DEFAULT_LIMIT, cursor: str | None = None,
                category_id=None) -> DataFrame:
    """L1 + L2 + F8 + F9: one page of the listing plus ``page_pos`` and the
    ``next_cursor`` (NULL on the last page). A cursor that does not decode
    is ignored (first page, Q16)."""
    check_page_args(sort, direction, limit)
    col = SORT_FIELDS[sort]
    df = products
    if category_id is not None:
        df = df.filter(F.col("category_id") == F.lit(category_id))
    if cursor is not None:
        spark = products.sparkSession
        dec = spark.range(1).select(decode_cursor(F.lit(cursor)).alias("d")).first()["d"]
        if dec is not None:
            sv = F.lit(dec["s"]).cast(df.schema[col].dataType)
            iv = F.lit(dec["i"]).cast(df.schema["id"].dataType)
            df = df.filter(keyset_after(col, "id", sv, iv, direction))
    top = df.orderBy(*_order(col, direction)).limit(limit + 1)  # TakeOrderedAndProject
    spark = products.sparkSession
    rows = top.collect()  # at most limit + 1 <= 101 rows
    has_more = len(rows) > limit
    page = rows[:limit]
    next_cursor = None
    if has_more:
        last = page[-1]
        sv = F.lit(last[col]).cast(top.schema[col].dataType)
        sv_text = decimal_sort_text(sv) if sort == "effective_price" else sv
        next_cursor = spark.range(1).select(encode_cursor(sv_text, F.lit(last["id"]))).first()[0]
    schema = StructType(top.schema.fields + [StructField("page_pos", LongType(), False),
                                             StructField("next_cursor", StringType(), True)])
    data = [tuple(r) + (i + 1, next_cursor) for i, r in enumerate(page)]
    return spark.createDataFrame(data, schema)


def listing_pages(products: DataFrame, sort: str = "effective_price", limit: int = DEFAULT_LIMIT,
                  per_category: bool = True) -> DataFrame:
    """Page number (1-based) and position of every product in the
    listing, per category (or over everything), with the cursor that leads
    to the page after it. Distributed global numbering: a hot category
    spreads over many tasks."""
    check_page_args(sort, "asc", limit)
    col = SORT_FIELDS[sort]
    keys = [F.col("category_id").asc()] if per_category else []
    numbered = global_row_number(products, keys + [F.col(col).asc(), F.col("id").asc()], out="__g")
    if per_category:
        first = numbered.groupBy("category_id").agg(F.min("__g").alias("__first"))
        numbered = join_small(numbered, first, "category_id", "inner")
        rank = F.col("__g") - F.col("__first")
    else:
        rank = F.col("__g") - F.lit(1)
    return (numbered.withColumn("page_no", (F.floor(rank / F.lit(limit)) + 1).cast("bigint"))
            .withColumn("page_pos", (rank % F.lit(limit) + 1).cast("bigint"))
            .withColumn("row_cursor", encode_cursor(sort_value_text(sort), F.col("id")))
            .drop("__g", "__first"))


def create_products(new_products: DataFrame, promotions: DataFrame, at: Column):
    """M8: new products pick up the newest live CATEGORY promotion of their
    category (W2): price under it and a link row. Returns (rows, links)."""
    cw = rules.live_category_winners(promotions, at).select(
        F.col("target_category_id").alias("__cat"), F.col("id").alias("__pid"),
        F.col("discount_type").alias("__t"), F.col("discount_value").alias("__v"))
    j = join_small(new_products, cw, new_products["category_id"] == cw["__cat"], "left",
                   salt_buckets=32, salt_source=F.col("sku"), big_key="category_id", small_key="__cat")
    rows = (j.withColumn("active_promotion_id", F.col("__pid"))
             .withColumn("effective_price", effective_price("base_price", "__t", "__v"))
             .drop("__cat", "__pid", "__t", "__v"))
    links = rows.filter(F.col("active_promotion_id").isNotNull()).select(
        F.col("id").alias("product_id"), F.col("active_promotion_id").alias("promotion_id"))
    return rows, links


def update_products(products: DataFrame, patches: DataFrame, promotions: DataFrame) -> DataFrame:
    """M9 (J8): partial updates ``id, name?, base_price?, stock_quantity?``.
    A base price change re-prices under the *held* promotion without a
    liveness test (Q12); no base change keeps the effective price."""
    pt = patches.select(F.col("id").alias("__id"), F.col("name").alias("__name"),
                        F.col("base_price").alias("__base"), F.col("stock_quantity").alias("__stock"))
    held = promotions.select(F.col("id").alias("__hid"), F.col("discount_type").alias("__t"),
                             F.col("discount_value").alias("__v"))
    j = products.join(pt, products["id"] == pt["__id"], "left")
    j = join_small(j, held, j["active_promotion_id"] == held["__hid"], "left",  # J8
                   big_key="active_promotion_id")
    has_base = F.col("__base").isNotNull()
    return (j.withColumn("changed", F.col("__id").isNotNull())
             .withColumn("name", F.coalesce(F.col("__name"), F.col("name")))
             .withColumn("stock_quantity", F.coalesce(F.col("__stock"), F.col("stock_quantity")))
             .withColumn("effective_price", F.when(has_base, effective_price(F.col("__base"), "__t", "__v"))
                         .otherwise(F.col("effective_price")))
             .withColumn("base_price", F.when(has_base, as_money("__base")).otherwise(F.col("base_price")))
             .drop("__id", "__name", "__base", "__stock", "__hid", "__t", "__v"))


def iso(col, df: DataFrame | None = None) -> Column:
    """ISO-8601 text with milliseconds and ``Z`` (UTC), like toISOString.

    A naive timestamp is rendered as is; an aware ``timestamp`` column of
    ``df`` is first turned into UTC wall-clock time, so the text does not
    depend on the session time zone.
    """
    c = F.col(col) if isinstance(col, str) else col
    if df is not None and isinstance(col, str) and isinstance(df.schema[col].dataType, TimestampType):
        c = F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz"))
    return F.date_format(c, ISO_FORMAT)


def product_view(products: DataFrame) -> DataFrame:
    """Money as 2-decimal text, timestamps ISO-8601 with ms and Z."""
    out = products.select(
        F.col("id"), "sku", "name", "category_id",
        format_money("base_price").alias("base_price"), "stock_quantity", "active_promotion_id",
        format_money("effective_price").alias("effective_price"),
        *[iso(c, products).alias(c) for c in ("effective_price_updated_at", "created_at", "updated_at")
          if c in products.columns])
    return out


def promotion_view(promotions: DataFrame) -> DataFrame:
    """P2."""
    cols = [F.col("id"), F.col("name"), F.col("discount_type"),
            format_money("discount_value").alias("discount_value"), F.col("scope"),
            F.col("target_product_id"), F.col("target_category_id"),
            iso("starts_at", promotions).alias("starts_at"), iso("ends_at", promotions).alias("ends_at"),
            F.col("status"), iso("created_at", promotions).alias("created_at")]
    if "updated_at" in promotions.columns:
        cols.append(iso("updated_at", promotions).alias("updated_at"))
    return promotions.select(*cols)


def batch_view(batches: DataFrame) -> DataFrame:
    """Nullable finished_at stays NULL."""
    return batches.select("id", "vendor_id", "source_file", "status", "total_rows",
                          "processed_rows", "failed_rows", iso("started_at", batches).alias("started_at"),
                          iso("finished_at", batches).alias("finished_at"))


def category_view(categories: DataFrame) -> DataFrame:
    """P4."""
    cols = [F.col("id"), F.col("name")]
    for c in ("created_at", "updated_at"):
        if c in categories.columns:
            cols.append(iso(c, categories).alias(c))
    return categories.select(*cols)


def latest_promotions(promotions: DataFrame, limit: int = DEFAULT_LIMIT, **filters) -> DataFrame:
    """L3 + F7: newest N promotions (created_at desc, id desc)."""
    check_page_args(limit=limit)
    df = rules.promotion_filter(promotions, **filters)
    return df.orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc()).limit(limit)


def categories_sorted(categories: DataFrame) -> DataFrame:
    """L4: categories by name (a distributed sort; range partitioned)."""
    return categories.orderBy("name")


def find_by_id(df: DataFrame, key, id_col: str = "id") -> DataFrame:
    """Point lookup (pushed down to the Parquet scan as a filter)."""
    return df.filter(F.col(id_col) == F.lit(key))


def find_by_ids(df: DataFrame, keys: DataFrame, id_col: str = "id") -> DataFrame:
    """S10 for many keys: semi join (no duplication, keys side broadcast
    by the planner when small)."""
    k = keys.select(F.col(keys.columns[0]).alias("__k")).distinct()
    return df.join(k, df[id_col] == k["__k"], "left_semi")
