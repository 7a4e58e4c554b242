"""Synthetic vendor feed (S12): the stress-test generator as a Spark job.

Row ``i`` is a pure function of ``i``, so any set of row numbers (a range
or keys of a table) becomes a feed in parallel, and ``write.csv`` streams
it out partition by partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values (must equal the reference's generator): the five
# round-robin categories, sku prefix and width, name prefix.
SYNTHETIC_CATEGORIES = ("Footwear", "Outerwear", "Accessories", "Bags", "Hats")
SKU_PREFIX = "STRESS-"
SKU_WIDTH = 8
NAME_PREFIX = "Synthetic Product "


def padded(text, width: int):
    """Zeros in front up to ``width``; longer text stays whole (lpad would cut it)."""
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def synthetic_rows(idx: DataFrame, i_col: str = "i") -> DataFrame:
    """Feed text columns for every row number in ``idx[i_col]``.

    base = 5 + (i % 50000)/100 (2 decimals); vendor cost = base x 0.95 on
    every third row (HALF_UP to 2 decimals; JS float ties may differ);
    stock = i % 500.
    """
    i = F.col(i_col).cast("bigint")
    base = ((F.lit(500) + i % 50000).cast("decimal(12,0)") * F.lit(0.01).cast("decimal(3,2)")).cast("decimal(12,2)")
    cats = F.array(*[F.lit(c) for c in SYNTHETIC_CATEGORIES])
    return idx.select(
        i.alias("row_index"),
        F.concat(F.lit(SKU_PREFIX), padded(i.cast("string"), SKU_WIDTH)).alias("sku"),
        F.concat(F.lit(NAME_PREFIX), i.cast("string")).alias("name"),
        F.element_at(cats, (i % len(SYNTHETIC_CATEGORIES) + 1).cast("int")).alias("category_name"),
        base.cast("string").alias("base_price"),
        F.when(i % 3 == 0, F.round(base * F.lit(0.95).cast("decimal(3,2)"), 2).cast("decimal(12,2)").cast("string"))
         .otherwise(F.lit("")).alias("vendor_cost"),
        (i % 500).cast("string").alias("stock_quantity"),
    )


def synthetic_feed(spark, n: int, partitions: int | None = None) -> DataFrame:
    """``n`` synthetic rows from ``spark.range`` (default 500 000 in the reference)."""
    if n <= 0:
        raise ValueError(f"Invalid row count: {n}")
    return synthetic_rows(spark.range(0, n, 1, partitions).withColumnRenamed("id", "i"))


def write_feed_csv(feed: DataFrame, path: str) -> None:
    """Write a feed as CSV with a header (one file per partition)."""
    cols = ["sku", "name", "category_name", "base_price", "vendor_cost", "stock_quantity"]
    feed.select(*cols).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


