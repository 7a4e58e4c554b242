"""Rollup queries over the event log: counters and histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfrate.functions.text import resource_of
from shelfrate.operators import rollup
from shelfrate.plans.catalog import register
from shelfrate.plans.sqltext import FEED_CTE, VALIDATED_CTE, ctes
from shelfrate.sources import driver_tables as dt


@register("counter_by_label", """
SELECT event_type AS label, CAST(count(*) AS BIGINT) AS value FROM events GROUP BY event_type""")
def counter_by_label(spark, sf_dir):
    """Events counted per label."""
    e = dt.event_log(spark, sf_dir)
    return rollup.counter(e, ["label"])


@register("weighted_counter", """
WITH k AS (SELECT event_type AS operation,
                  CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'product:' || CAST(user_id AS VARCHAR)
                       ELSE 'session:' || CAST(user_id AS VARCHAR) END AS cache_key,
                  CAST(json_extract(props, '$.k') AS BIGINT) AS weight FROM events)
SELECT operation, CASE WHEN starts_with(cache_key, 'product:') THEN 'product' ELSE 'other' END AS resource,
       CAST(sum(weight) AS BIGINT) AS value
FROM k GROUP BY 1, 2""")
def weighted_counter(spark, sf_dir):
    """Weighted counter by (operation, resource from key prefix)."""
    e = dt.event_log(spark, sf_dir)
    key = F.when(F.col("label").isin("view", "click", "purchase"),
                 F.concat(F.lit("product:"), F.col("user_id").cast("string"))).otherwise(
        F.concat(F.lit("session:"), F.col("user_id").cast("string")))
    k = e.select(F.col("label").alias("operation"), resource_of(key).alias("resource"), "weight")
    return rollup.counter(k, ["operation", "resource"], weight="weight")


def _hist_sql(labels_sql: str, label_names: list[str], value_sql: str, buckets, where: str = "") -> str:
    les = [rollup._le_text(b) for b in buckets]
    cases = ",\n".join(f"CAST(count(*) FILTER (WHERE v <= {b}) AS BIGINT) AS b{i}" for i, b in enumerate(buckets))
    unions = "\nUNION ALL ".join(
        f"SELECT {', '.join(label_names)}, '{le}' AS le, b{i} AS bucket_count, cnt AS count, total AS sum FROM wide"
        for i, le in enumerate(les))
    unions += f"\nUNION ALL SELECT {', '.join(label_names)}, '+Inf', cnt, cnt, total FROM wide"
    return f"""WITH base AS (SELECT {labels_sql}, {value_sql} AS v FROM events {where}),
wide AS (SELECT {', '.join(label_names)}, {cases},
                CAST(count(*) AS BIGINT) AS cnt, sum(v) AS total FROM base GROUP BY {', '.join(label_names)})
{unions}"""


HTTP_LABELS_SQL = """CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method,
       CASE WHEN event_type = 'error' THEN 'unmatched' ELSE '/' || event_type END AS route,
       CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status_code"""
PATH_SQL = "CASE WHEN user_id % 10 = 0 THEN '/health' ELSE '/' || event_type END"


@register("latency_histogram", _hist_sql(
    HTTP_LABELS_SQL, ["method", "route", "status_code"],
    "CAST(value AS DECIMAL(12,2)) * CAST(0.01 AS DECIMAL(3,2))", rollup.HTTP_BUCKETS,
    where=f"WHERE {PATH_SQL} NOT IN ('/metrics', '/health', '/ready')"))
def latency_histogram(spark, sf_dir):
    """Request-duration histogram by (method, route, status) over the
    event log read as a request log; probe paths ignored, unmatched routes
    labelled."""
    e = dt.read_table(spark, sf_dir, "events")
    et = F.col("event_type")
    req = e.select(
        F.when(et.isin("purchase", "signup"), F.lit("POST")).otherwise(F.lit("GET")).alias("method"),
        rollup.route_label(F.when(et != "error", F.concat(F.lit("/"), et))).alias("route"),
        F.when(et == "error", F.lit("500")).otherwise(F.lit("200")).alias("status_code"),
        F.when(F.col("user_id") % 10 == 0, F.lit("/health")).otherwise(F.concat(F.lit("/"), et)).alias("path"),
        (F.col("value").cast("decimal(12,2)") * F.lit(0.01).cast("decimal(3,2)")).alias("seconds"))
    return rollup.histogram(rollup.request_log_filter(req), ["method", "route", "status_code"], "seconds",
                            rollup.HTTP_BUCKETS)


@register("materialization_histogram", _hist_sql(
    "event_type AS kind", ["kind"], "CAST(value AS DECIMAL(12,2))", rollup.MATERIALIZATION_BUCKETS))
def materialization_histogram(spark, sf_dir):
    """A10: duration histogram by kind with the materialization buckets."""
    e = dt.read_table(spark, sf_dir, "events")
    d = e.select(F.col("event_type").alias("kind"), F.col("value").cast("decimal(12,2)").alias("seconds"))
    return rollup.histogram(d, ["kind"], "seconds", rollup.MATERIALIZATION_BUCKETS)


@register("ingest_rows_by_status", ctes(FEED_CTE, VALIDATED_CTE) + """
SELECT lower(status) AS status, CAST(count(*) AS BIGINT) AS value FROM checked GROUP BY 1""")
def ingest_rows_by_status(spark, sf_dir):
    """A5: ingest row counter by status (ok / failed)."""
    from shelfrate.operators import feed as fd
    v = fd.validate(dt.feed(spark, sf_dir)).select(F.lower("status").alias("status"))
    return rollup.counter(v, ["status"])


@register("promotions_by_scope", """
SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'CATEGORY' ELSE 'PRODUCT' END AS scope,
       CAST(count(*) AS BIGINT) AS value
FROM orders GROUP BY 1""")
def promotions_by_scope(spark, sf_dir):
    """Promotions created, by scope."""
    return rollup.counter(dt.promotions(spark, sf_dir), ["scope"])
