"""Adapters from the driver's parquet tables to the catalogue shapes.

The derivations are fixed by the test contract (FIXTURES part B) so that
the DuckDB oracle can build the same views; they are plain projections and
keep predicate pushdown and column pruning intact.
"""

from __future__ import annotations

import datetime as _dt
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrate.schemas import MONEY

# Fixed instant used by every as-of query on the driver tables.
AS_OF = _dt.datetime(1998, 6, 15, 0, 0, 0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def as_of_lit(ts: _dt.datetime = AS_OF) -> Column:
    """Instant literal in the type of the naive driver timestamps, built from
    text so that neither the Python nor the session time zone shifts it."""
    return F.lit(ts.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """products (id, sku, name, category_id, base_price, stock_quantity) from part."""
    p = read_table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("SKU-"), F.col("p_partkey").cast("string")).alias("sku"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("category_id"),
        F.col("p_retailprice").cast(MONEY).alias("base_price"),
        F.col("p_size").alias("stock_quantity"),
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """categories (id, name): one per brand; the brand text is both."""
    return (read_table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"))
            .distinct().select(F.col("name").alias("id"), "name"))


def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """promotions from orders (one request per order)."""
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    is_cat = (k % 50) == 0
    return o.select(
        k.alias("id"),
        F.concat(F.lit("promo-"), k.cast("string")).alias("name"),
        F.when(k % 3 == 0, F.lit("FIXED_AMOUNT")).otherwise(F.lit("PERCENTAGE")).alias("discount_type"),
        (F.lit(1) + k % 60).cast(MONEY).alias("discount_value"),
        F.when(is_cat, F.lit("CATEGORY")).otherwise(F.lit("PRODUCT")).alias("scope"),
        F.when(~is_cat, F.col("o_custkey")).alias("target_product_id"),
        F.when(is_cat, F.concat(F.lit("Brand#"),
                                ((F.floor(k / 50).cast("bigint") % 25) + 1).cast("string"))
               ).alias("target_category_id"),
        F.col("o_orderdate").alias("starts_at"),
        F.when(is_cat, F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS"))
         .otherwise(F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("ends_at"),
        F.when(k % 11 == 0, F.lit("CANCELLED")).when(k % 13 == 0, F.lit("EXPIRED"))
         .when(k % 2 == 0, F.lit("SCHEDULED")).otherwise(F.lit("ACTIVE")).alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw vendor feed (all text, with injected defects) from part.

    ``row_index`` is the feed order (the part key).
    """
    p = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    sku_num = F.when(k % 71 == 0, k + 1).otherwise(k + (k % 2) * 1000000)
    return p.select(
        k.alias("row_index"),
        F.when(k % 97 == 0, F.lit("")).otherwise(
            F.concat(F.lit("SKU-"), sku_num.cast("string"))).alias("sku"),
        F.col("p_name").alias("name"),
        F.when(k % 61 == 0, F.concat(F.lit("New#"), (k % 5).cast("string")))
         .otherwise(F.col("p_brand")).alias("category_name"),
        F.when(k % 89 == 0, F.lit("not-a-number")).otherwise(
            (F.col("p_retailprice").cast("decimal(12,3)") + F.lit(0.005).cast("decimal(4,3)"))
            .cast("string")).alias("base_price"),
        F.when(k % 3 == 0, (F.col("p_retailprice").cast(MONEY) * F.lit(0.95).cast("decimal(3,2)"))
               .cast("string")).otherwise(F.lit("")).alias("vendor_cost"),
        F.when(k % 83 == 0, F.lit("-1")).otherwise(F.col("p_size").cast("string")).alias("stock_quantity"),
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log for rollups: label, weight (props.k), value, time."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.col("event_type").alias("label"),
        F.get_json_object("props", "$.k").try_cast("bigint").alias("weight"),
        F.col("value"),
        F.col("ts"),
        F.col("user_id"),
        F.col("props"),
    )
