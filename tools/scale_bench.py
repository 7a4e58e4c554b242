"""

* feed ingest: synthetic feed (default 500 000 rows, 16 CSV files) ->
  validate, price, categories, upsert, ledger -> written snapshot versions;
* category apply / revert over N synthetic products (default 5 000 000) in
  1000 categories, one of which holds a third of all products (hot key).

Prints one JSON line. Used by bench.py (``extras``) and runnable alone.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402


def feed_ingest(spark, rows: int, files: int, scratch: str) -> dict:
    from shelfrate.sources.feed_csv import list_csv_files
    from shelfrate.sources.snapshots import SnapshotStore
    from shelfrate.sources.synthetic import synthetic_feed, write_feed_csv
    from shelfrate.streaming.ingest import ingest_files

    inbox = os.path.join(scratch, "inbox")
    write_feed_csv(synthetic_feed(spark, rows).repartition(files), inbox)
    paths = list_csv_files(spark, [inbox])
    arrivals = spark.createDataFrame([(p, "stress-test", f"synthetic-{i}.csv", i) for i, p in enumerate(paths)],
                                     "path string, vendor_id string, source_file string, arrival long")
    store = SnapshotStore(spark, os.path.join(scratch, "store"))
    t0 = time.time()
    ingest_files(spark, store, arrivals, F.lit(dt.datetime(2026, 1, 1)))
    secs = time.time() - t0
    return {"feed_rows": rows, "feed_files": len(paths), "feed_ingest_sec": round(secs, 2),
            "feed_rows_per_sec": round(rows / secs, 1)}


def category_apply(spark, n: int, categories: int = 1000) -> dict:
    from shelfrate.operators import promote

    at = F.lit(dt.datetime(2026, 1, 10))
    hot = F.col("id") % 3 == 0  # a third of all products in one category
    products = spark.range(n).select(
        F.col("id").cast("string").alias("id"),
        F.when(hot, F.lit("cat-0")).otherwise(F.concat(F.lit("cat-"), (F.col("id") % categories).cast("string")))
         .alias("category_id"),
        ((F.col("id") % 50000 + 500).cast("decimal(12,0)") * F.lit(Decimal("0.01"))).cast("decimal(12,2)")
        .alias("base_price"),
        F.lit(None).cast("string").alias("active_promotion_id"),
        ((F.col("id") % 50000 + 500).cast("decimal(12,0)") * F.lit(Decimal("0.01"))).cast("decimal(12,2)")
        .alias("effective_price"))
    promos = spark.range(categories).select(
        F.concat(F.lit("promo-"), F.col("id").cast("string")).alias("id"),
        F.when(F.col("id") % 2 == 0, F.lit("PERCENTAGE")).otherwise(F.lit("FIXED_AMOUNT")).alias("discount_type"),
        (F.col("id") % 40 + 5).cast("decimal(12,2)").alias("discount_value"),
        F.lit("CATEGORY").alias("scope"), F.lit(None).cast("string").alias("target_product_id"),
        F.concat(F.lit("cat-"), F.col("id").cast("string")).alias("target_category_id"),
        F.lit(dt.datetime(2026, 1, 1)).alias("starts_at"), F.lit(dt.datetime(2026, 2, 1)).alias("ends_at"),
        F.lit("ACTIVE").alias("status"), F.lit(dt.datetime(2026, 1, 1)).alias("created_at"))
    t0 = time.time()
    snap, changes = promote.apply_category(products, promos, promos, at)
    snap.write.format("noop").mode("overwrite").save()
    apply_s = time.time() - t0
    t0 = time.time()
    reverted, _ = promote.revert_category(snap.drop("changed"), promos.select("id"))
    reverted.write.format("noop").mode("overwrite").save()
    revert_s = time.time() - t0
    return {"apply_products": n, "apply_categories": categories, "category_apply_sec": round(apply_s, 2),
            "category_revert_sec": round(revert_s, 2)}


def main():
    from shelfrate.session import build_session, scratch_dir
    spark = build_session(f"local[{os.environ.get('BENCH_CPUS', '8')}]", shuffle_partitions=16)
    spark.sparkContext.setLogLevel("ERROR")
    scratch = scratch_dir(spark, f"scale-{int(time.time())}")
    out = feed_ingest(spark, int(os.environ.get("FEED_ROWS", "500000")), 16, scratch)
    out.update(category_apply(spark, int(os.environ.get("APPLY_PRODUCTS", "5000000"))))
    print(json.dumps(out))


if __name__ == "__main__":
    main()
