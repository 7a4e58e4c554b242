"""Data-quality operators: table CHECKs, foreign keys, uniqueness, request
and patch validation (V5-V16). Each returns the offending rows with the
rule that failed; nothing is dropped silently.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfrate.schemas import DISCOUNT_TYPES, SCOPES

# Fixed values (must equal the reference's): decimal text with at most two
# fractional digits, and the messages of the create/update rules.
MONEY_TEXT = r"^\d+(\.\d{1,2})?\z"
MONEY_TEXT_MSG = "expected a decimal with up to 2 fractional digits"
ENDS_AFTER_MSG = "endsAt: endsAt must be after startsAt"
TARGET_MSG = ("scope: For scope=PRODUCT set targetProductId; for scope=CATEGORY set "
              "targetCategoryId. Set exactly one.")
FUTURE_MSG = "endsAt must be in the future"
AT_LEAST_ONE_MSG = "at least one field must be provided"


def _join_issues(issues: list[Column]) -> Column:
    joined = F.array_join(F.filter(F.array(*issues), lambda x: x.isNotNull()), "; ")
    return F.when(joined == "", F.lit(None)).otherwise(joined)


def _len(col: str, path: str, lo: int, hi: int, required: bool = True) -> Column:
    c = F.col(col)
    first = F.when(c.isNull(), F.lit(f"{path}: Required")) if required else F.when(c.isNull(), F.lit(None))
    return (first.when(F.length(c) < lo, F.lit(f"{path}: String must contain at least {lo} character(s)"))
                 .when(F.length(c) > hi, F.lit(f"{path}: String must contain at most {hi} character(s)")))


def _money_text(col: str, path: str, required: bool = True) -> Column:
    c = F.col(col)
    bad = ~F.regexp_like(c, F.lit(MONEY_TEXT))
    if required:
        return F.when(c.isNull(), F.lit(f"{path}: Required")).when(bad, F.lit(f"{path}: {MONEY_TEXT_MSG}"))
    return F.when(c.isNotNull() & bad, F.lit(f"{path}: {MONEY_TEXT_MSG}"))


def _int_min0(col: str, path: str, required: bool = True) -> Column:
    c = F.col(col)
    first = F.when(c.isNull(), F.lit(f"{path}: Required")) if required else F.when(c.isNull(), F.lit(None))
    return first.when(c < 0, F.lit(f"{path}: Number must be greater than or equal to 0"))


def product_create_errors() -> Column:
    """V5: sku 1..64, name 1..255, category id present, base text <= 2 dp, stock int >= 0."""
    return _join_issues([_len("sku", "sku", 1, 64), _len("name", "name", 1, 255),
                         F.when(F.col("category_id").isNull(), F.lit("categoryId: Required")),
                         _money_text("base_price", "basePrice"),
                         _int_min0("stock_quantity", "stockQuantity")])


def category_create_errors(requests: DataFrame, categories: DataFrame) -> DataFrame:
    """V8 + V12: ``requests`` (with ``name``) and ``error``: a bad length, or a name that is taken."""
    taken = categories.select(F.col("name").alias("__taken")).distinct()
    j = requests.join(taken, requests["name"] == taken["__taken"], "left")
    exists = F.when(F.col("__taken").isNotNull(), F.concat(F.lit('Category "'), F.col("name"), F.lit('" already exists')))
    return j.withColumn("error", F.coalesce(_len("name", "name", 1, 255), exists)).drop("__taken")


def product_patch_errors() -> Column:
    """V6: optional fields with the same rules; at least one present."""
    none = F.col("name").isNull() & F.col("base_price").isNull() & F.col("stock_quantity").isNull()
    return _join_issues([_len("name", "name", 1, 255, required=False),
                         _money_text("base_price", "basePrice", required=False),
                         _int_min0("stock_quantity", "stockQuantity", required=False),
                         F.when(none, F.lit(AT_LEAST_ONE_MSG))])


def promotion_request_errors(at: Column | None = None) -> Column:
    """V7 + V14 (+ V13 when ``at`` is given) on request rows with text
    ``discount_value``."""
    sc = F.col("scope")
    target_ok = F.when(sc == "PRODUCT", F.col("target_product_id").isNotNull()
                       & F.col("target_category_id").isNull()).otherwise(
        F.col("target_category_id").isNotNull() & F.col("target_product_id").isNull())
    issues = [_len("name", "name", 1, 255),
              F.when(~F.col("discount_type").isin(*DISCOUNT_TYPES),
                     F.lit("discountType: Invalid enum value. Expected 'PERCENTAGE' | 'FIXED_AMOUNT'")),
              _money_text("discount_value", "discountValue"),
              F.when(~sc.isin(*SCOPES), F.lit("scope: Invalid enum value. Expected 'PRODUCT' | 'CATEGORY'")),
              F.when(F.col("ends_at") <= F.col("starts_at"), F.lit(ENDS_AFTER_MSG)),
              F.when(sc.isin(*SCOPES) & ~target_ok, F.lit(TARGET_MSG))]
    if at is not None:
        issues.append(F.when(F.col("ends_at") <= at, F.lit(FUTURE_MSG)))
    return _join_issues(issues)


def constraint_violations(products: DataFrame, promotions: DataFrame) -> DataFrame:
    """Table CHECKs as (table_name, id, rule) rows."""
    pv = [("products", products, F.col("base_price") < 0, "base_price_nonnegative"),
          ("products", products, F.col("stock_quantity") < 0, "stock_nonnegative")]
    target_ok = F.when(F.col("scope") == "PRODUCT", F.col("target_product_id").isNotNull()
                       & F.col("target_category_id").isNull()).otherwise(
        F.col("target_category_id").isNotNull() & F.col("target_product_id").isNull())
    qv = [("promotions", promotions, ~target_ok, "exactly_one_target"),
          ("promotions", promotions, F.col("ends_at") <= F.col("starts_at"), "ends_after_starts"),
          ("promotions", promotions, F.col("discount_value") <= 0, "discount_value_positive")]
    parts = [df.filter(cond).select(F.lit(t).alias("table_name"), F.col("id").cast("string").alias("id"),
                                    F.lit(rule).alias("rule"))
             for t, df, cond, rule in pv + qv]
    return reduce(DataFrame.unionByName, parts)


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str, label: str) -> DataFrame:
    """Child rows whose foreign key has no parent (left anti join)."""
    p = parent.select(F.col(pk).alias("__pk"))
    return (child.filter(F.col(fk).isNotNull())
            .join(p, child[fk] == p["__pk"], "left_anti")
            .select(F.lit(label).alias("fk"), F.col(fk).cast("string").alias("missing_key")))


def duplicate_keys(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Keys occurring more than once, with their count."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
            .select(F.lit(label).alias("constraint_name"),
                    F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"),
                    F.col("n").cast("bigint").alias("n")))


def cancel_errors(status: str = "status") -> Column:
    """Cancelling a CANCELLED promotion is a conflict (EXPIRED may be cancelled)."""
    return F.when(F.col(status) == "CANCELLED", F.lit("Promotion is already cancelled"))
