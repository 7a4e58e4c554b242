"""Promotion materialization on the product snapshot.

State goes in as DataFrames and comes out as a new snapshot plus a change
set. ``products`` carries ``id, category_id, base_price,
active_promotion_id, effective_price`` (other columns pass through).
The promotions being applied are reduced to one row per category before
they meet the products, then broadcast behind a measured size check, so
the (possibly skewed) product table is never shuffled by category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfrate.functions.money import as_money, effective_price
from shelfrate.operators import rules
from shelfrate.operators.quality import cancel_errors, promotion_request_errors
from shelfrate.plans.joins import join_small

# Fixed value (must equal the reference's): cache invalidation group size.
INVALIDATE_CHUNK = 1000


def stamped(products: DataFrame, hit: Column, at: Column | None) -> DataFrame:
    """The time columns that ``products`` has, set to ``at`` on the rows whose price a job changed."""
    cols = [c for c in ("effective_price_updated_at", "updated_at") if c in products.columns and at is not None]
    return products.withColumns({c: F.when(hit, at.cast(dict(products.dtypes)[c])).otherwise(F.col(c)) for c in cols})


def _one_per_category(to_apply: DataFrame) -> DataFrame:
    """Several promotions for one category: the last applied (newest) wins."""
    cat = to_apply.filter(F.col("scope") == "CATEGORY")
    return rules.top1_per_key(cat, "target_category_id",
                              [F.col("created_at").desc_nulls_last(), F.col("id").desc()])


def outranking_product_holders(products: DataFrame, promotions: DataFrame, at: Column) -> DataFrame:
    """J1 helper: ids of products whose held promotion is a live PRODUCT one."""
    live_prod = promotions.filter((F.col("scope") == "PRODUCT") & rules.is_live(at)).select(
        F.col("id").alias("__held"))
    return products.join(live_prod, products["active_promotion_id"] == live_prod["__held"],
                         "left_semi").select("id")


def apply_category(products: DataFrame, promotions: DataFrame, to_apply: DataFrame,
                   at: Column) -> tuple[DataFrame, DataFrame]:
    """M4 + J1: apply CATEGORY promotions to every product of their category.

    A product is re-priced and takes the promotion unless it currently holds
    a live PRODUCT promotion (the NOT EXISTS of the reference, as a left
    anti join). Liveness of the applied promotion itself is not tested
    (the caller filters, as in the reference).

    Returns (new snapshot with ``changed`` flag, change set of product ids).
    """
    apply = _one_per_category(to_apply).select(
        F.col("target_category_id").alias("__cat"), F.col("id").alias("__promo"),
        F.col("discount_type").alias("__type"), F.col("discount_value").alias("__value"))
    p = join_small(products, apply, products["category_id"] == apply["__cat"], "left", salt_buckets=32,
                   salt_source=F.col("id"), big_key="category_id", small_key="__cat")
    # Live PRODUCT promotions, narrowed to the ids actually held by
    # products of the applied categories, then joined on that unique id —
    # broadcast when measured small, so the catalogue is not shuffled.
    held = p.filter(F.col("__promo").isNotNull() & F.col("active_promotion_id").isNotNull()).select(
        F.col("active_promotion_id").alias("__h")).distinct()
    live_prod = promotions.filter((F.col("scope") == "PRODUCT") & rules.is_live(at)).select(
        F.col("id").alias("__held_live"))
    live_prod = live_prod.join(held, live_prod["__held_live"] == held["__h"], "left_semi")
    p = join_small(p, live_prod, p["active_promotion_id"] == live_prod["__held_live"], "left",
                   big_key="active_promotion_id")
    hit = F.col("__promo").isNotNull() & F.col("__held_live").isNull()
    out = (p.withColumn("changed", hit)
            .withColumn("active_promotion_id",
                        F.when(hit, F.col("__promo")).otherwise(F.col("active_promotion_id")))
            .withColumn("effective_price",
                        F.when(hit, effective_price("base_price", "__type", "__value"))
                         .otherwise(F.col("effective_price")))
            .drop("__cat", "__promo", "__type", "__value", "__held_live"))
    out = stamped(out, F.col("changed"), at)
    return out, out.filter("changed").select("id")


def category_links(products: DataFrame, to_apply: DataFrame, links: DataFrame | None = None,
                   at: Column | None = None) -> DataFrame:
    """M3: link rows (product_id, promotion_id) for *all* products of the
    category, insert-ignore against existing ``links``; with ``at`` they
    carry it as ``applied_at``."""
    cats = to_apply.filter(F.col("scope") == "CATEGORY").select(
        F.col("target_category_id").alias("__cat"), F.col("id").alias("promotion_id"))
    new = join_small(products.select(F.col("id").alias("product_id"), "category_id"), cats,
                     F.col("category_id") == F.col("__cat"), "inner",
                     salt_buckets=32, salt_source=F.col("product_id"),
                     big_key="category_id", small_key="__cat").select("product_id", "promotion_id")
    if links is not None:
        new = new.join(links.select("product_id", "promotion_id"), ["product_id", "promotion_id"],
                       "left_anti")
    return new if at is None else new.withColumn("applied_at", at)


def revert_category(products: DataFrame, reverted_ids: DataFrame,
                    at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """M5: products holding a reverted promotion fall back to base price and
    no promotion (links are kept). ``reverted_ids`` has column ``id``; time
    columns of the products are set to ``at`` when it is given."""
    rv = reverted_ids.select(F.col("id").alias("__rv")).distinct()
    p = join_small(products, rv, products["active_promotion_id"] == rv["__rv"], "left",
                   big_key="active_promotion_id")
    hit = F.col("__rv").isNotNull()
    out = (p.withColumn("changed", hit)
            .withColumn("active_promotion_id", F.when(hit, F.lit(None)).otherwise(F.col("active_promotion_id")))
            .withColumn("effective_price", F.when(hit, as_money("base_price")).otherwise(F.col("effective_price")))
            .drop("__rv"))
    out = stamped(out, F.col("changed"), at)
    return out, out.filter("changed").select("id")


def cancel_refusals(promotions: DataFrame, cancel_ids: DataFrame) -> DataFrame:
    """(id, reason) of the cancellations that are refused: unknown or already cancelled promotions."""
    wanted = cancel_ids.select(F.col("id").alias("__cx")).distinct()
    j = wanted.join(promotions.select("id", "status"), F.col("__cx") == F.col("id"), "left")
    reason = F.when(F.col("id").isNull(), F.concat(F.lit("Promotion "), F.col("__cx").cast("string"), F.lit(" not found"))
                    ).otherwise(cancel_errors())
    return j.select(F.col("__cx").alias("id"), reason.alias("reason")).filter(F.col("reason").isNotNull())


def cancel_promotions(promotions: DataFrame, cancel_ids: DataFrame, at: Column | None = None) -> DataFrame:
    """Status flip to CANCELLED (first half of M6/M7); refused ones (V16) stay as they are."""
    c = cancel_ids.select(F.col("id").alias("__cx")).distinct()
    p = join_small(promotions, c, promotions["id"] == c["__cx"], "left")
    hit = F.col("__cx").isNotNull() & (F.col("status") != "CANCELLED")
    if at is not None and "updated_at" in promotions.columns:
        p = p.withColumn("updated_at", F.when(hit, at.cast(dict(promotions.dtypes)["updated_at"]))
                         .otherwise(F.col("updated_at")))
    return p.withColumn("status", F.when(hit, F.lit("CANCELLED")).otherwise(F.col("status"))).drop("__cx")


def cancel_product(products: DataFrame, promotions: DataFrame, cancel_ids: DataFrame,
                   at: Column) -> tuple[DataFrame, DataFrame]:
    """M6: cancel PRODUCT promotions; every carrier is re-evaluated with the
    winner rule (W1) over the remaining live promotions, else base price."""
    promos_after = cancel_promotions(promotions, cancel_ids, at)
    cx = cancel_ids.select(F.col("id").alias("__cx")).distinct()
    p = join_small(products, cx, products["active_promotion_id"] == cx["__cx"], "left",
                   big_key="active_promotion_id")
    carriers = p.filter(F.col("__cx").isNotNull()).drop("__cx")
    others = p.filter(F.col("__cx").isNull()).drop("__cx").withColumn("changed", F.lit(False))
    rew = rules.winners_as_of(carriers.drop("discount_type", "discount_value", "winner_id",
                                            "winner_scope"), promos_after, at)
    redone = (rew.withColumn("active_promotion_id", F.col("winner_id"))
                 .withColumn("effective_price", effective_price("base_price", "discount_type",
                                                                "discount_value"))
                 .withColumn("changed", F.lit(True))
                 .drop("winner_id", "winner_scope", "discount_type", "discount_value"))
    redone = stamped(redone, F.lit(True), at)
    out = others.unionByName(redone.select(*others.columns))
    return out, redone.select("id")


def cancel_category(products: DataFrame, promotions: DataFrame, cancel_ids: DataFrame, at: Column | None = None):
    """M7: status flip + M5 revert. Returns (promotions, products, change set)."""
    promos_after = cancel_promotions(promotions, cancel_ids, at)
    snap, changes = revert_category(products, cancel_ids, at)
    return promos_after, snap, changes


def invalidation_keys(change_set: DataFrame, id_col: str = "id") -> DataFrame:
    """``product:{id}`` keys with their group of 1000 (by id order).

    Group numbers come from a distributed global row number (no
    single-task window)."""
    from shelfrate.plans.ordering import global_row_number
    keyed = change_set.select(F.col(id_col).alias("product_id")).distinct()
    numbered = global_row_number(keyed, [F.col("product_id").asc()], out="__rn")
    return numbered.select(
        F.concat(F.lit("product:"), F.col("product_id").cast("string")).alias("cache_key"),
        F.floor((F.col("__rn") - 1) / F.lit(INVALIDATE_CHUNK)).cast("bigint").alias("group_index"))


def request_refusals(requests: DataFrame, products: DataFrame, at: Column,
                     categories: DataFrame | None = None) -> DataFrame:
    """(id, reason) of the requests that are refused before any conflict is looked for.

    The form of the request and its window come first; then its target must
    exist (a category: in ``categories``, by default among the products').
    """
    form = requests.withColumn("discount_value", F.col("discount_value").cast("string"))
    if "name" not in form.columns:
        form = form.withColumn("name", F.col("id").cast("string"))
    form = form.withColumn("reason", promotion_request_errors(at))
    bad = form.filter(F.col("reason").isNotNull()).select("id", "reason")
    good = form.filter(F.col("reason").isNull())
    known = {"PRODUCT": products.select(F.col("id").alias("__key")),
             "CATEGORY": (categories.select(F.col("id").alias("__key")) if categories is not None
                          else products.select(F.col("category_id").alias("__key")).distinct())}
    for scope, target in (("PRODUCT", "target_product_id"), ("CATEGORY", "target_category_id")):
        asked = good.filter(F.col("scope") == scope)
        gone = asked.join(known[scope], asked[target] == F.col("__key"), "left_anti")
        bad = bad.unionByName(gone.select("id", F.concat(
            F.lit(scope.capitalize() + " "), F.col(target).cast("string"), F.lit(" not found")).alias("reason")))
    return bad


def create_promotions(requests: DataFrame, promotions: DataFrame, products: DataFrame,
                      at: Column, categories: DataFrame | None = None) -> dict:
    """M10 + M11 over a set of creation requests (batch form of the API).

    Refused requests (``request_refusals``) come back as decisions with
    their reason; the others are admitted serially per target (M12).
    Admitted ones become promotions with status ACTIVE (window started) or
    SCHEDULED (X8). PRODUCT promotions always get a link row and, when
    ACTIVE, re-price their product; ACTIVE CATEGORY promotions are applied
    to their category (M3 + M4). Returns ``decisions``, ``promotions``
    (existing + created), ``products`` (new snapshot), ``links`` (new link
    rows).
    """
    from shelfrate.operators.admission import admit

    refused = request_refusals(requests, products, at, categories).checkpoint(eager=True)
    valid = requests.join(refused.select("id"), "id", "left_anti")
    admitted = admit(valid, promotions, products)
    decisions = admitted.unionByName(
        requests.select("id", "scope").join(refused, "id").select(
            "id", "scope", F.lit(False).alias("admitted"), "reason",
            F.lit(None).cast(dict(admitted.dtypes)["conflicting_promotion_id"]).alias("conflicting_promotion_id")))
    created = (valid.join(admitted.filter("admitted").select("id"), "id", "left_semi")
               .withColumn("status", rules.initial_status(at)).drop("arrival"))
    all_promos = promotions.unionByName(created, allowMissingColumns=True)
    active = created.filter(F.col("status") == "ACTIVE")
    # PRODUCT: newest ACTIVE admitted request per product re-prices it
    prod_new = rules.top1_per_key(active.filter(F.col("scope") == "PRODUCT"), "target_product_id",
                                  [F.col("created_at").desc_nulls_last(), F.col("id").desc()]).select(
        F.col("target_product_id").alias("__tp"), F.col("id").alias("__np"),
        F.col("discount_type").alias("__nt"), F.col("discount_value").alias("__nv"))
    p = join_small(products, prod_new, products["id"] == prod_new["__tp"], "left")
    hit = F.col("__np").isNotNull()
    p = (stamped(p, hit, at)
         .withColumn("active_promotion_id", F.when(hit, F.col("__np")).otherwise(F.col("active_promotion_id")))
         .withColumn("effective_price", F.when(hit, effective_price("base_price", "__nt", "__nv"))
                     .otherwise(F.col("effective_price")))
         .drop("__tp", "__np", "__nt", "__nv"))
    cat_active = active.filter(F.col("scope") == "CATEGORY")
    snap, _ = apply_category(p, all_promos, cat_active, at)
    links = (created.filter(F.col("scope") == "PRODUCT").select(
        F.col("target_product_id").alias("product_id"), F.col("id").alias("promotion_id"), at.alias("applied_at"))
        .unionByName(category_links(products, cat_active, at=at)))
    return {"decisions": decisions, "promotions": all_promos, "products": snap.drop("changed"),
            "links": links}
