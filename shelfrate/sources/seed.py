"""Sample seed catalogue (S13) applied with the seed upsert.

Categories are insert-only; products are upserted by sku with name,
category, base price and stock updated but the stored effective price kept.
Re-running is a no-op.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrate.operators import feed as fd

# Fixed values (must equal the reference's seed): three categories and seven
# products as (sku, name, category, base price, stock).
SEED_CATEGORIES = ("Footwear", "Outerwear", "Accessories")
SEED_PRODUCTS = (
    ("SEED-SNK-01", "Trail Runner", "Footwear", "120.00", 25),
    ("SEED-SNK-02", "Court Sneaker", "Footwear", "95.00", 40),
    ("SEED-BOO-01", "Hiking Boot", "Footwear", "180.00", 10),
    ("SEED-JKT-01", "Rain Shell", "Outerwear", "220.00", 15),
    ("SEED-JKT-02", "Down Puffer", "Outerwear", "299.99", 8),
    ("SEED-HAT-01", "Beanie", "Accessories", "24.50", 100),
    ("SEED-BAG-01", "Day Pack", "Accessories", "79.00", 30),
)


def seed_rows(spark: SparkSession) -> DataFrame:
    """The seed products as validated feed rows."""
    rows = [(i, sku, name, cat, Decimal(price), stock, "OK")
            for i, (sku, name, cat, price, stock) in enumerate(SEED_PRODUCTS)]
    return spark.createDataFrame(rows, "row_index long, sku string, name string, category_name string, "
                                       "base_price_norm decimal(12,2), stock_qty int, status string")


def apply_seed(spark: SparkSession, products: DataFrame, categories: DataFrame, promotions: DataFrame,
               at: Column) -> tuple[DataFrame, DataFrame]:
    """Returns (categories, products) after the seed (M14 + M2)."""
    names = spark.createDataFrame([(n,) for n in SEED_CATEGORIES], "category_name string")
    cats = fd.resolve_categories(names, categories)
    new_cats = cats.filter("is_new").select("id", "name")
    all_cats = categories.select("id", "name").unionByName(new_cats)
    snap = fd.upsert_products(products, seed_rows(spark), cats, promotions, at, update_effective=False)
    # inserted rows start at effective = base (reference: effectivePrice = basePrice)
    return all_cats, snap.withColumn("effective_price", F.coalesce("effective_price", "base_price"))
