"""Source-side queries: synthetic feed, object keys, message decoding."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfrate.functions.text import feed_file_error, object_key_parts
from shelfrate.plans.catalog import register
from shelfrate.plans.joins import release_measured
from shelfrate.session import scratch_dir
from shelfrate.sources import driver_tables as dt
from shelfrate.sources.feed_csv import list_csv_files
from shelfrate.sources.messages import split_messages
from shelfrate.sources.quoted_csv import read_quoted_feed
from shelfrate.sources.synthetic import synthetic_rows
from shelfrate.streaming.retries import MAX_ATTEMPTS, MessageLog, drain, final_outcomes, start_message_stream


@register("synthetic_feed", """
SELECT p_partkey AS row_index,
       'STRESS-' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS sku,
       'Synthetic Product ' || CAST(p_partkey AS VARCHAR) AS name,
       CASE p_partkey % 5 WHEN 0 THEN 'Footwear' WHEN 1 THEN 'Outerwear' WHEN 2 THEN 'Accessories'
                          WHEN 3 THEN 'Bags' ELSE 'Hats' END AS category_name,
       CAST(CAST(CAST(500 + p_partkey % 50000 AS DECIMAL(12,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(12,2)) AS VARCHAR)
         AS base_price,
       CASE WHEN p_partkey % 3 = 0 THEN CAST(CAST(round(CAST(CAST(500 + p_partkey % 50000 AS DECIMAL(12,0))
              * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(12,2)) * CAST(0.95 AS DECIMAL(3,2)), 2) AS DECIMAL(12,2)) AS VARCHAR)
            ELSE '' END AS vendor_cost,
       CAST(p_partkey % 500 AS VARCHAR) AS stock_quantity
FROM part""")
def synthetic_feed(spark, sf_dir):
    """The generator's rows for every part key as row number."""
    p = dt.read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"))
    return synthetic_rows(p)


KEY_SQL = ("'raw/' || regexp_extract(url, '://([^/?#]+)', 1) || '/feed' || "
           "CASE WHEN page_id % 2 = 0 THEN '%5F' ELSE '+' END || CAST(page_id AS VARCHAR) || '.csv'")


@register("object_key_parse", f"""
WITH k AS (SELECT page_id, {KEY_SQL} AS object_key FROM pages),
d AS (SELECT page_id, object_key, string_split(url_decode(replace(object_key, '+', ' ')), '/') AS parts FROM k)
SELECT page_id, object_key, parts[2] AS vendor_id,
       CASE WHEN len(parts) >= 3 THEN array_to_string(parts[3:], '/') ELSE '' END AS source_file,
       CASE WHEN NOT regexp_matches(CASE WHEN len(parts) >= 3 THEN array_to_string(parts[3:], '/') ELSE '' END,
                                    '^[A-Za-z0-9._-]+\\.csv\\z', 'i')
            THEN 'sourceFile: sourceFile must be a *.csv filename, no path components' END AS file_error
FROM d""")
def object_key_parse(spark, sf_dir):
    """Object keys (built from page hosts) decoded to vendor and file,
    with the feed-name admission check."""
    pg = dt.read_table(spark, sf_dir, "pages")
    key = F.concat(F.lit("raw/"), F.regexp_extract("url", r"://([^/?#]+)", 1), F.lit("/feed"),
                   F.when(F.col("page_id") % 2 == 0, F.lit("%5F")).otherwise(F.lit("+")),
                   F.col("page_id").cast("string"), F.lit(".csv"))
    k = pg.select("page_id", key.alias("object_key")).withColumn("__p", object_key_parts("object_key"))
    return k.select("page_id", "object_key", F.col("__p.vendor_id").alias("vendor_id"),
                    F.col("__p.source_file").alias("source_file"),
                    feed_file_error(F.col("__p.source_file")).alias("file_error"))


@register("dead_letter_split", """
WITH m AS (SELECT event_id,
                  CASE WHEN event_type = 'error' THEN substr(props, 1, length(props) - 1) ELSE props END AS body
           FROM events)
SELECT event_id,
       CASE WHEN json_valid(body) THEN 'OK' ELSE 'DEAD_LETTER' END AS outcome,
       CASE WHEN json_valid(body) THEN CAST(json_extract(body, '$.k') AS BIGINT) END AS k
FROM m""")
def dead_letter_split(spark, sf_dir):
    """Message bodies (error events arrive truncated) decoded; the
    malformed ones go to the dead-letter side, the rest continue."""
    e = dt.read_table(spark, sf_dir, "events")
    body = F.when(F.col("event_type") == "error",
                  F.expr("substr(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    good, dead = split_messages(e.select("event_id", body.alias("body")), "body")
    return (good.select("event_id", F.lit("OK").alias("outcome"),
                        F.col("message.k").cast("bigint").alias("k"))
            .unionByName(dead.select("event_id", F.lit("DEAD_LETTER").alias("outcome"),
                                     F.lit(None).cast("bigint").alias("k"))))


@register("quoted_feed", """
SELECT CAST(doc_id AS VARCHAR) AS sku, md5(coalesce(text, '')) AS text_md5, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars,
       CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS n_lines, coalesce(lang, '') AS category, FALSE AS corrupt
FROM documents""")
def quoted_feed(spark, sf_dir):
    """Whole texts delivered as quoted CSV cells with line breaks, read back in splits."""
    release_measured()
    folder = scratch_dir(spark, f"quoted-{uuid.uuid4().hex}")
    docs = dt.read_table(spark, sf_dir, "documents")
    (docs.select(F.col("doc_id").alias("sku"), F.col("text").alias("name"), F.col("lang").alias("category"))
     .write.options(header="true", quoteAll="true", escape='"', ignoreLeadingWhiteSpace="false",
                    ignoreTrailingWhiteSpace="false").csv(folder))
    feed = read_quoted_feed(spark, list_csv_files(spark, [folder]), ("sku", "name", "category"))
    return feed.select("sku", F.md5(F.col("name").cast("binary")).alias("text_md5"),
                       F.length("name").cast("bigint").alias("n_chars"),
                       F.size(F.split("name", "\n")).cast("bigint").alias("n_lines"), "category",
                       F.col("_corrupt_record").isNotNull().alias("corrupt"))


@register("message_retries", f"""
WITH m AS (SELECT event_id, CASE WHEN event_type = 'error' THEN substr(props, 1, length(props) - 1) ELSE props END AS body FROM events),
d AS (SELECT event_id, json_valid(body) AS ok,
             CASE WHEN json_valid(body) THEN CAST(json_extract(body, '$.k') AS BIGINT) % 5 END AS failures FROM m)
SELECT event_id, CASE WHEN ok AND failures < {MAX_ATTEMPTS} THEN 'OK' ELSE 'DEAD_LETTER' END AS outcome,
       CASE WHEN NOT ok THEN 1 WHEN failures < {MAX_ATTEMPTS} THEN failures + 1 ELSE {MAX_ATTEMPTS} END::INTEGER AS attempts,
       CASE WHEN NOT ok THEN 'MALFORMED_JSON' WHEN failures >= {MAX_ATTEMPTS} THEN 'busy' END AS reason
FROM d""")
def message_retries(spark, sf_dir):
    """The events as a message stream whose messages fail k mod 5 times; error events arrive truncated."""
    folder = scratch_dir(spark, f"messages-{uuid.uuid4().hex}")
    body = F.when(F.col("event_type") == "error", F.expr("substr(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    (dt.read_table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("message_id"), body.alias("body"))
     .repartition("message_id").write.parquet(f"{folder}/inbox"))
    n_files = len(spark.read.parquet(f"{folder}/inbox").inputFiles())
    stream = (spark.readStream.schema("message_id string, body string").option("maxFilesPerTrigger", -(-n_files // 3))
              .parquet(f"{folder}/inbox"))
    log = MessageLog(spark, f"{folder}/log")

    def process(good):
        busy = F.col("attempts") <= F.col("message.k") % 5
        return good.select("message_id", F.when(busy, F.lit("busy")).alias("error"))

    query = start_message_stream(stream, log, process, f"{folder}/checkpoint")
    query.awaitTermination()
    drain(log, process)
    return final_outcomes(log).select(F.col("message_id").cast("bigint").alias("event_id"), "outcome", "attempts", "reason")
