"""Listing queries: keyset pages, bulk page numbers, cursor round trip."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfrate.functions.text import decimal_sort_text, decode_cursor, encode_cursor
from shelfrate.operators import catalog
from shelfrate.plans.catalog import register
from shelfrate.plans.sqltext import PRODUCTS_CTE, PROMOTIONS_CTE, WINNER_CTES, ctes

STATE = ctes(PRODUCTS_CTE, PROMOTIONS_CTE) + ", " + WINNER_CTES


def _dec_text_sql(x: str) -> str:
    return (f"CASE WHEN strpos(CAST({x} AS VARCHAR), '.') > 0 "
            f"THEN regexp_replace(regexp_replace(CAST({x} AS VARCHAR), '0+$', ''), '\\.$', '') "
            f"ELSE CAST({x} AS VARCHAR) END")


def _cursor_sql(s: str, i: str) -> str:
    js = f"'{{\"s\":\"' || {s} || '\",\"i\":\"' || CAST({i} AS VARCHAR) || '\"}}'"
    return f"rtrim(replace(replace(to_base64(encode({js})), '+', '-'), '/', '_'), '=')"


def _page_sql(lo: int, hi: int) -> str:
    return STATE + f""",
ranked AS (SELECT id, effective_price,
                  row_number() OVER (ORDER BY effective_price ASC, id ASC) AS rn,
                  count(*) OVER () AS total FROM state),
nc AS (SELECT CASE WHEN total > {hi} THEN {_cursor_sql(_dec_text_sql('effective_price'), 'id')} END
              AS next_cursor FROM ranked WHERE rn = {hi})
SELECT r.id, r.effective_price, r.rn - {lo - 1} AS page_pos, nc.next_cursor
FROM ranked r LEFT JOIN nc ON true WHERE r.rn BETWEEN {lo} AND {hi}"""


def _priced(spark, sf_dir):
    from shelfrate.plans.pricing_queries import _state
    return _state(spark, sf_dir).select("id", "effective_price")


@register("keyset_first_page", _page_sql(1, 20))
def keyset_first_page(spark, sf_dir):
    """L1 L2: first page of 20 by (effective_price, id) with the next cursor."""
    return catalog.keyset_page(_priced(spark, sf_dir), "effective_price", "asc", 20).select(
        "id", "effective_price", "page_pos", "next_cursor")


@register("keyset_next_page", _page_sql(21, 40))
def keyset_next_page(spark, sf_dir):
    """The page after the first, reached through its cursor."""
    priced = _priced(spark, sf_dir)
    first = catalog.keyset_page(priced, "effective_price", "asc", 20)
    cursor = first.select("next_cursor").first()["next_cursor"]
    return catalog.keyset_page(priced, "effective_price", "asc", 20, cursor=cursor).select(
        "id", "effective_price", "page_pos", "next_cursor")


@register("listing_pages", STATE + f""",
r AS (SELECT id, category_id, effective_price,
             row_number() OVER (PARTITION BY category_id ORDER BY effective_price, id) - 1 AS rk
      FROM state)
SELECT id, category_id, effective_price, CAST(floor(rk / 20) + 1 AS BIGINT) AS page_no,
       CAST(rk % 20 + 1 AS BIGINT) AS page_pos,
       {_cursor_sql(_dec_text_sql('effective_price'), 'id')} AS row_cursor
FROM r""")
def listing_pages(spark, sf_dir):
    """Page number and position of every product per category listing."""
    from shelfrate.plans.pricing_queries import _state
    s = _state(spark, sf_dir).select("id", "category_id", "effective_price")
    return catalog.listing_pages(s, "effective_price", 20, per_category=True)


@register("cursor_roundtrip", STATE + f""",
c AS (SELECT id, {_cursor_sql(_dec_text_sql('effective_price'), 'id')} AS cursor FROM state),
d AS (SELECT id, cursor,
             decode(from_base64(replace(replace(cursor, '-', '+'), '_', '/')
                    || repeat('=', CAST((4 - length(cursor) % 4) % 4 AS INTEGER)))) AS js FROM c)
SELECT id, cursor, json_extract_string(js, '$.s') AS sort_value, json_extract_string(js, '$.i') AS cursor_id
FROM d""")
def cursor_roundtrip(spark, sf_dir):
    """Encode every product's cursor and decode it back."""
    from shelfrate.plans.pricing_queries import _state
    s = _state(spark, sf_dir)
    c = s.select("id", encode_cursor(decimal_sort_text("effective_price"), F.col("id")).alias("cursor"))
    d = c.withColumn("__d", decode_cursor("cursor"))
    return d.select("id", "cursor", F.col("__d.s").alias("sort_value"), F.col("__d.i").alias("cursor_id"))
