"""Structured Streaming: file-arrival ingest, stateful admission, counters."""

import datetime as dt
import os
import random

import pytest
from admission_reference import admit_reference

from shelfrate.sources.snapshots import SnapshotStore
from shelfrate.streaming.admission import admit_stream
from shelfrate.streaming.counters import start_counter_query
from shelfrate.streaming.ingest import start_feed_stream


def test_feed_stream_replay_is_noop(spark, tmp_dir):
    raw = os.path.join(tmp_dir, "inbox", "raw", "acme")
    os.makedirs(raw)
    with open(os.path.join(raw, "one.csv"), "w") as fh:
        fh.write("sku,name,category_name,base_price,stock_quantity\nS-1,A,Cat,10.00,1\nS-2,B,Cat,x,1\n")
    store_root = os.path.join(tmp_dir, "store")
    ckpt = os.path.join(tmp_dir, "ckpt")
    at = dt.datetime(2026, 1, 1)
    q = start_feed_stream(spark, os.path.join(tmp_dir, "inbox"), store_root, ckpt, at=at)
    q.awaitTermination(120)
    store = SnapshotStore(spark, store_root)
    b = store.read("ingest_batches").first()
    assert (b["vendor_id"], b["source_file"], b["status"], b["processed_rows"], b["failed_rows"]) == \
        ("acme", "one.csv", "COMPLETED", 1, 1)
    v = store.latest_version("products")
    # second file arrives; first one is not processed again
    with open(os.path.join(raw, "two.csv"), "w") as fh:
        fh.write("sku,name,category_name,base_price,stock_quantity\nS-3,C,Cat,5.00,2\n")
    q = start_feed_stream(spark, os.path.join(tmp_dir, "inbox"), store_root, ckpt, at=at)
    q.awaitTermination(120)
    assert store.latest_version("products") == v + 1
    assert sorted(r["sku"] for r in store.read("products").collect()) == ["S-1", "S-3"]
    assert store.read("ingest_batches").count() == 2


REQUESTS = ("id string, scope string, target_product_id string, target_category_id string, "
            "starts_at timestamp, ends_at timestamp, arrival long")


@pytest.mark.parametrize("batches", [1, 4])
def test_streaming_admission_does_not_depend_on_the_cuts(spark, tmp_dir, batches):
    rng = random.Random(4)
    category_of = {f"p{i}": f"c{i % 2}" for i in range(4)}
    requests = []
    for n in range(40):
        start = dt.datetime(2026, 1, 1) + dt.timedelta(days=rng.randrange(300))
        scope = rng.choice(["PRODUCT", "PRODUCT", "CATEGORY"])
        requests.append({"id": f"r{n:02d}", "scope": scope, "starts_at": start,
                         "target_product_id": f"p{rng.randrange(5)}" if scope == "PRODUCT" else None,  # p4: no category
                         "target_category_id": f"c{rng.randrange(2)}" if scope == "CATEGORY" else None,
                         "ends_at": start + dt.timedelta(days=rng.randrange(1, 40)), "arrival": n // 2})
    src, out = os.path.join(tmp_dir, "requests"), os.path.join(tmp_dir, "decisions")
    os.makedirs(src)
    products = spark.createDataFrame(list(category_of.items()), "id string, category_id string")
    stream = spark.readStream.schema(REQUESTS).parquet(src)
    size = len(requests) // batches
    for k in range(0, len(requests), size):
        rows = [tuple(r[c.split(" ")[0]] for c in REQUESTS.split(", ")) for r in requests[k:k + size]]
        spark.createDataFrame(rows, REQUESTS).write.mode("append").parquet(src)
        (admit_stream(stream, products).writeStream.outputMode("append").format("parquet").option("path", out)
         .option("checkpointLocation", os.path.join(tmp_dir, "ckpt")).trigger(availableNow=True).start().awaitTermination(180))
    got = {r["id"]: r["admitted"] for r in spark.read.parquet(out).collect()}
    assert got == admit_reference(requests, [], category_of)


def test_streaming_counters(spark, tmp_dir):
    src = os.path.join(tmp_dir, "events")
    spark.createDataFrame([("hit", 1), ("miss", 1), ("hit", 1)], "operation string, w long") \
        .write.parquet(src)
    stream = spark.readStream.schema("operation string, w long").parquet(src)
    seen = {}

    def sink(df, epoch):
        for r in df.collect():  # updated labels only: a handful of rows
            seen[r["operation"]] = r["value"]

    q = start_counter_query(stream, ["operation"], sink, os.path.join(tmp_dir, "ck"))
    q.awaitTermination(120)
    assert seen == {"hit": 2, "miss": 1}
