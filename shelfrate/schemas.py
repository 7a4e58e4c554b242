"""StructTypes of the catalogue tables (the reference's relational schema)."""

from pyspark.sql.types import (DecimalType, IntegerType, StringType, StructField,
                               StructType, TimestampType)

MONEY = DecimalType(12, 2)

CATEGORIES = StructType([
    StructField("id", StringType(), False),
    StructField("name", StringType(), False),
    StructField("created_at", TimestampType(), True),
    StructField("updated_at", TimestampType(), True),
])

PRODUCTS = StructType([
    StructField("id", StringType(), False),
    StructField("sku", StringType(), False),
    StructField("name", StringType(), False),
    StructField("category_id", StringType(), False),
    StructField("base_price", MONEY, False),
    StructField("stock_quantity", IntegerType(), False),
    StructField("active_promotion_id", StringType(), True),
    StructField("effective_price", MONEY, False),
    StructField("effective_price_updated_at", TimestampType(), True),
    StructField("created_at", TimestampType(), True),
    StructField("updated_at", TimestampType(), True),
])

PROMOTIONS = StructType([
    StructField("id", StringType(), False),
    StructField("name", StringType(), True),
    StructField("discount_type", StringType(), False),
    StructField("discount_value", MONEY, False),
    StructField("scope", StringType(), False),
    StructField("target_product_id", StringType(), True),
    StructField("target_category_id", StringType(), True),
    StructField("starts_at", TimestampType(), False),
    StructField("ends_at", TimestampType(), False),
    StructField("status", StringType(), False),
    StructField("created_at", TimestampType(), True),
    StructField("updated_at", TimestampType(), True),
])

PRODUCT_PROMOTIONS = StructType([
    StructField("product_id", StringType(), False),
    StructField("promotion_id", StringType(), False),
    StructField("applied_at", TimestampType(), True),
])

INGEST_BATCHES = StructType([
    StructField("id", StringType(), False),
    StructField("vendor_id", StringType(), False),
    StructField("source_file", StringType(), False),
    StructField("status", StringType(), False),
    StructField("total_rows", IntegerType(), True),
    StructField("processed_rows", IntegerType(), False),
    StructField("failed_rows", IntegerType(), False),
    StructField("started_at", TimestampType(), True),
    StructField("finished_at", TimestampType(), True),
])

INGEST_ROW_RESULTS = StructType([
    StructField("batch_id", StringType(), False),
    StructField("row_key", StringType(), False),
    StructField("status", StringType(), False),
    StructField("error_message", StringType(), True),
    StructField("processed_at", TimestampType(), True),
])

# Raw feed row: every column is text, as read from the CSV header.
FEED_COLUMNS = ("sku", "name", "category_name", "base_price", "vendor_cost", "stock_quantity")
RAW_FEED = StructType([StructField(c, StringType(), True) for c in FEED_COLUMNS])

# Fixed values of the domain (must equal the reference's).
DISCOUNT_TYPES = ("PERCENTAGE", "FIXED_AMOUNT")
SCOPES = ("PRODUCT", "CATEGORY")
PROMOTION_STATUSES = ("SCHEDULED", "ACTIVE", "CANCELLED", "EXPIRED")
UNFINISHED_STATUSES = ("ACTIVE", "SCHEDULED")

# Key by which a stored table is divided into buckets: what an ingest looks its rows up by.
TABLE_KEYS = {
    "products": ("sku",),
    "categories": ("name",),
    "ingest_batches": ("vendor_id", "source_file"),
    "ingest_row_results": ("batch_id",),
}

# Order of the rows in the files of a stored table that is asked for one status and a time: other pages are skipped.
TABLE_ORDER = {"promotions": ("status", "starts_at")}
