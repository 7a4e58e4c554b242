"""Promotion rules: liveness, overlap, applicability, winners, conflicts.

F1-F6, F11, F12, J2-J4, W1-W3 and X7/X8 of the survey, all as Catalyst
expressions and joins. Two invariants keep the plans scalable:

* "applicable to a product" is never an OR join (that plans a nested loop):
  PRODUCT promotions join on the product key, CATEGORY promotions on the
  category key, and the two branches are unioned.
* winners are reduced per key *before* they meet the product table
  (top-1 per key with a partial, map-side WindowGroupLimit), so the side
  joined to products holds at most one row per product / category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfrate.functions.money import effective_price
from shelfrate.plans.joins import join_small
from shelfrate.schemas import UNFINISHED_STATUSES

# Fixed values (must equal the reference's): scope precedence, conflict
# reasons and the conflict payload's error name and message.
SCOPE_RANK = {"PRODUCT": 0, "CATEGORY": 1}
REASON_PRODUCT = "EXISTING_PRODUCT_PROMOTION"
REASON_CATEGORY = "EXISTING_CATEGORY_PROMOTION"
CONFLICT_ERROR = "PromotionConflict"
CONFLICT_MESSAGE = ("An existing active or scheduled promotion already applies to this "
                    "target for the requested time window.")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- predicates

def is_unfinished(status="status") -> Column:
    return _c(status).isin(*UNFINISHED_STATUSES)


def is_live(at: Column, status="status", starts_at="starts_at", ends_at="ends_at") -> Column:
    """ACTIVE/SCHEDULED and starts_at <= at < ends_at (end exclusive)."""
    return is_unfinished(status) & (_c(starts_at) <= at) & (at < _c(ends_at))


def is_live_strict(at: Column, status="status", starts_at="starts_at", ends_at="ends_at") -> Column:
    """the ingest variant — status must be exactly ACTIVE."""
    return (_c(status) == "ACTIVE") & (_c(starts_at) <= at) & (at < _c(ends_at))


def windows_overlap(a_start, a_end, b_start, b_end) -> Column:
    """[a_start, a_end) and [b_start, b_end) intersect (end exclusive)."""
    return (_c(a_start) < _c(b_end)) & (_c(b_start) < _c(a_end))


def scope_rank(scope="scope") -> Column:
    """PRODUCT ranks before CATEGORY."""
    return F.when(_c(scope) == "PRODUCT", F.lit(SCOPE_RANK["PRODUCT"])).otherwise(
        F.lit(SCOPE_RANK["CATEGORY"]))


def initial_status(at: Column, starts_at="starts_at") -> Column:
    """ACTIVE when the window has started at ``at``, else SCHEDULED."""
    return F.when(_c(starts_at) <= at, F.lit("ACTIVE")).otherwise(F.lit("SCHEDULED"))


def promotion_filter(promotions: DataFrame, status=None, scope=None,
                     target_product_id=None, target_category_id=None) -> DataFrame:
    """optional, ANDed list filters."""
    df = promotions
    for col, val in (("status", status), ("scope", scope),
                     ("target_product_id", target_product_id),
                     ("target_category_id", target_category_id)):
        if val is not None:
            df = df.filter(F.col(col) == F.lit(val))
    return df


# ------------------------------------------------------------------ winners

def _winner_order() -> list[Column]:
    """Newest created_at first, missing created_at last, then id (deterministic)."""
    return [F.col("created_at").desc_nulls_last(), F.col("id").desc()]


def top1_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Top-1 row per ``key``; Catalyst inserts a partial WindowGroupLimit so
    a hot key is cut to one row per map partition before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")


def live_product_winners(promotions: DataFrame, at: Column) -> DataFrame:
    """Per product: the newest live PRODUCT promotion."""
    live = promotions.filter((F.col("scope") == "PRODUCT") & is_live(at))
    return top1_per_key(live.select("id", "target_product_id", "discount_type", "discount_value",
                                    "created_at"),
                        "target_product_id", _winner_order())


def live_category_winners(promotions: DataFrame, at: Column) -> DataFrame:
    """Per category, the newest live CATEGORY promotion."""
    live = promotions.filter((F.col("scope") == "CATEGORY") & is_live(at))
    return top1_per_key(live.select("id", "target_category_id", "discount_type", "discount_value",
                                    "created_at"),
                        "target_category_id", _winner_order())


def winners_as_of(products: DataFrame, promotions: DataFrame, at: Column,
                  exclude_promotion_id=None) -> DataFrame:
    """W1 + J2 + J4: per product, the winning live promotion at ``at``.

    PRODUCT beats CATEGORY; within a scope the newest ``created_at`` wins.
    Returns products with ``winner_id``, ``winner_scope``, ``discount_type``,
    ``discount_value`` (NULLs when nothing is live).
    """
    promos = promotions
    if exclude_promotion_id is not None:  # F12
        promos = promos.filter(F.col("id") != F.lit(exclude_promotion_id))
    pw = live_product_winners(promos, at).select(
        F.col("target_product_id").alias("__pid"),
        F.col("id").alias("__p_id"),
        F.col("discount_type").alias("__p_type"),
        F.col("discount_value").alias("__p_value"))
    cw = live_category_winners(promos, at).select(
        F.col("target_category_id").alias("__cid"),
        F.col("id").alias("__c_id"),
        F.col("discount_type").alias("__c_type"),
        F.col("discount_value").alias("__c_value"))
    # Product winners: at most one row per product. Broadcast when measured
    # small, else a shuffle join on the product key (no skew: unique keys).
    j = join_small(products, pw, products["id"] == pw["__pid"], "left")
    # Category winners: at most one row per category, bounded by the
    # category count -> broadcast behind the check; salted otherwise since
    # one category may hold a large share of all products.
    j = join_small(j, cw, j["category_id"] == cw["__cid"], "left",
                   salt_buckets=32, salt_source=F.col("id"),
                   big_key="category_id", small_key="__cid")
    has_p = F.col("__p_id").isNotNull()
    has_c = F.col("__c_id").isNotNull()
    return (j.withColumn("winner_id", F.when(has_p, F.col("__p_id")).otherwise(F.col("__c_id")))
             .withColumn("winner_scope", F.when(has_p, F.lit("PRODUCT"))
                         .when(has_c, F.lit("CATEGORY")))
             .withColumn("discount_type", F.when(has_p, F.col("__p_type")).otherwise(F.col("__c_type")))
             .withColumn("discount_value", F.when(has_p, F.col("__p_value")).otherwise(F.col("__c_value")))
             .drop("__pid", "__p_id", "__p_type", "__p_value", "__cid", "__c_id", "__c_type", "__c_value"))


def effective_prices_as_of(products: DataFrame, promotions: DataFrame, at: Column) -> DataFrame:
    """Flagship: every product with its winning promotion and effective price at ``at``."""
    w = winners_as_of(products, promotions, at)
    return w.withColumn("effective_price",
                        effective_price("base_price", "discount_type", "discount_value"))


# --------------------------------------------------------------- applicable

def applicable_promotions(products: DataFrame, promotions: DataFrame,
                          unfinished_only: bool = True) -> DataFrame:
    """(product, promotion) pairs where the promotion targets the
    product directly or through its category. Two equi joins + union.

    The CATEGORY branch multiplies products by the category's promotions;
    callers narrow ``promotions`` (e.g. to live ones) first.
    """
    promos = promotions.filter(is_unfinished()) if unfinished_only else promotions
    prods = products.select(F.col("id").alias("product_id"), "category_id")
    by_product = prods.join(
        promos.filter(F.col("scope") == "PRODUCT"),
        prods["product_id"] == promos["target_product_id"], "inner")
    by_category = prods.join(
        promos.filter(F.col("scope") == "CATEGORY"),
        prods["category_id"] == promos["target_category_id"], "inner")
    return by_product.unionByName(by_category)


# ---------------------------------------------------------------- conflicts

def conflict_reason(existing_scope="existing_scope") -> Column:
    return F.when(_c(existing_scope) == "PRODUCT", F.lit(REASON_PRODUCT)).otherwise(
        F.lit(REASON_CATEGORY))


def conflict_payload(df: DataFrame) -> DataFrame:
    """The conflict payload fields."""
    return df.select("*", F.lit(CONFLICT_ERROR).alias("error"),
                     F.col("existing_id").alias("conflicting_promotion_id"),
                     F.lit(CONFLICT_MESSAGE).alias("message"))
