"""Serialized admission of promotion requests (M12, batch form of M10/M11).

The reference serializes concurrent creations per target with row and
advisory locks: of two overlapping requests on one target the earlier one
is accepted and the later one rejected with a reason. Here a whole set of
requests is decided at once:

1. Conflicts with *existing* unfinished promotions reject right away; they
   are found by a pair-free sweep per target (``plans.ranges.overlaps_any``).
2. CATEGORY requests are checked against CATEGORY promotions only (Q1), so
   they are decided first. PRODUCT requests are then checked against the
   admitted CATEGORY requests of their product's category that arrived
   earlier, again relationally.
3. What is left is the genuinely sequential part: requests on the same
   target that overlap each other. They are split into time-connected
   components (a later window that starts after every earlier window has
   ended cannot interact with them; labelled by a distributed prefix scan,
   so a hot target spreads over many tasks) and each (target, component) is
   folded in arrival order: small ones fold inside Catalyst, large ones
   stream through a pandas fold over rows sorted by arrival (sorted interval
   list, O(log n) per request, memory bounded by the accepted windows), and
   very large ones are first decided in rounds over all tasks
   (``decide_in_rounds``), as far as rounds get ahead.
4. The reported conflict of every rejected request is recomputed
   relationally as the first blocker that arrived before it (see
   ``first_blockers``).

No step pairs windows: stage 2 and the reasons ask for the first blocker by
``plans.ranges.earliest_overlap``, however many windows of a target meet.

Requests carry ``id, scope, target_product_id, target_category_id,
starts_at, ends_at, created_at`` and an ``arrival`` rank (ties broken by
``id``).
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrate.functions.timeutil import epoch_micros
from shelfrate.operators import rules
from shelfrate.plans.joins import join_small
from shelfrate.plans.ordering import interval_components
from shelfrate.plans.ranges import earliest_overlap, overlaps_any



def _components(df: DataFrame, key: str) -> DataFrame:
    """Time-connected components of windows per key (``__comp`` label),
    computed by a distributed prefix scan (``plans.ordering``) so a hot
    target spreads over many tasks."""
    return interval_components(df, key, "starts_at", "ends_at", "id", out="__comp")


def _fold_sorted(batches):
    """Greedy admission over rows sorted by (target, component, arrival, id).

    Streams Arrow batches: the only state is the accepted windows of the
    current component (sorted, pairwise disjoint), reset when the
    (target, component) changes, so memory does not grow with the group.
    """
    group = None
    starts: list = []
    ends: list = []
    for b in batches:
        oks = []
        for k, c, s, e in zip(b["__key"], b["__comp"], b["s"], b["e"]):
            if (k, c) != group:
                group, starts, ends = (k, c), [], []
            i = bisect.bisect_right(starts, s)
            clash = (i > 0 and ends[i - 1] > s) or (i < len(starts) and starts[i] < e)
            if not clash:
                starts.insert(i, s)
                ends.insert(i, e)
            oks.append(not clash)
        yield pd.DataFrame({"id": b["id"].values, "ok": oks})


# Components up to this many requests fold inside Catalyst (higher-order
# ``aggregate`` over the component's requests, quadratic but tiny); larger
# ones go to the pandas fold with its sorted interval list.
CATALYST_FOLD_MAX = 128


def _catalyst_fold(df: DataFrame, key: str, id_type: str) -> DataFrame:
    grouped = df.groupBy(key, "__comp").agg(
        F.array_sort(F.collect_list(F.struct("arrival", "id", "s", "e"))).alias("__reqs"))
    fold = F.expr(f"""aggregate(__reqs,
        named_struct('acc', CAST(array() AS array<struct<s:bigint,e:bigint>>),
                     'out', CAST(array() AS array<struct<id:{id_type},ok:boolean>>)),
        (st, r) -> CASE WHEN exists(st.acc, a -> a.s < r.e AND r.s < a.e)
            THEN named_struct('acc', st.acc,
                              'out', array_append(st.out, named_struct('id', r.id, 'ok', false)))
            ELSE named_struct('acc', array_append(st.acc, named_struct('s', r.s, 'e', r.e)),
                              'out', array_append(st.out, named_struct('id', r.id, 'ok', true)))
            END,
        st -> st.out)""")
    return grouped.select(F.inline(fold))


# Components beyond this many requests are first decided in rounds.
ROUNDS_MIN = 200_000
# Rounds go on while each decides at least this share of what is left.
MIN_PROGRESS = 0.05


def decide_in_rounds(requests: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Greedy admission of overlapping requests without a sequential fold.

    ``requests`` has ``id``, the key, ``starts_at``, ``ends_at`` and
    ``arrival``. In each round every request that arrived before all
    undecided ones it overlaps is admitted, which is what the fold would do,
    and whatever overlaps an admitted request is rejected. A round is two
    sweeps over the sorted line, however dense a target is. Arrivals in no
    particular order need about log(n) rounds; where each request waits for
    the one before it (arrivals in the order of the windows), a round decides
    little and the rounds end.

    Returns (id, ok, round) of the decided requests and the undecided rest.
    """
    left = requests.select("id", F.col(key).alias("key"), F.col("starts_at").alias("start"),
                           F.col("ends_at").alias("end"), "arrival").checkpoint(eager=True)
    decided, count, number = None, left.count(), 0
    while count:
        number += 1
        first = earliest_overlap(
            left.select("key", "start", "end", F.struct("arrival", "id").alias("id")),
            left.select("key", "start", "end", "arrival", F.col("id").alias("bid")),
            {"first": F.struct(F.col("arrival"), F.col("bid").alias("id"))})
        blocked = first.filter(F.col("first") < F.col("id")).select("id.id")
        admitted = left.join(blocked, "id", "left_anti").checkpoint(eager=True)
        waiting = left.join(admitted.select("id"), "id", "left_anti")
        lost = overlaps_any(waiting, admitted.select(F.col("key").alias("bk"), F.col("start").alias("bs"),
                                                     F.col("end").alias("be")),
                            "key", "bk", "start", "end", "bs", "be").checkpoint(eager=True)
        now = admitted.select("id", F.lit(True).alias("ok"), F.lit(number).alias("round")).unionByName(
            lost.select("id", F.lit(False).alias("ok"), F.lit(number).alias("round")))
        decided = now if decided is None else decided.unionByName(now)
        left = waiting.join(lost, "id", "left_anti").checkpoint(eager=True)
        before, count = count, left.count()
        if before - count < MIN_PROGRESS * before:
            break
    if decided is None:
        decided = left.select("id", F.lit(True).alias("ok"), F.lit(0).alias("round"))
    rest = requests.join(left.select("id"), "id", "left_semi")
    return decided, rest


def _fold_by_key(df: DataFrame, key: str) -> DataFrame:
    """``id, ok`` for every request: small components fold in Catalyst, larger
    ones in a stream of sorted rows, very large ones first go through rounds."""
    comp = _components(df, key)
    id_type = df.schema["id"].dataType.simpleString()
    # A component's label holds the id that opened it, so it is unique over all targets.
    sizes = comp.groupBy("__comp").agg(F.count("*").alias("__size")).filter(
        F.col("__size") > CATALYST_FOLD_MAX).checkpoint(eager=True)
    comp = join_small(comp, sizes, "__comp", "left")
    if not sizes.filter(F.col("__size") > ROUNDS_MIN).isEmpty():
        decided, rest = decide_in_rounds(comp.filter(F.col("__size") > ROUNDS_MIN), key)
        other = comp.filter(F.coalesce("__size", F.lit(0)) <= ROUNDS_MIN).select(*df.columns)
        if not rest.isEmpty():
            rest = _fold_components(_components(rest.select(*df.columns), key).withColumn(
                "__size", F.lit(ROUNDS_MIN)), key, id_type)
            decided = decided.select("id", "ok").unionByName(rest)
        return decided.select("id", "ok").unionByName(_fold_by_key(other, key))
    return _fold_components(comp, key, id_type)


def _fold_components(comp: DataFrame, key: str, id_type: str) -> DataFrame:
    """``id, ok`` of requests labelled with their component; ``__size`` is set on large components."""
    rows = comp.select("id", key, "__comp", "arrival", "__size",
                       epoch_micros(comp, "starts_at").alias("s"), epoch_micros(comp, "ends_at").alias("e"))
    small = _catalyst_fold(rows.filter(F.col("__size").isNull()), key, id_type)
    # Large components: each lands whole in one partition (hash on target and
    # component), sorted by arrival inside it, and is folded as a stream.
    large = (rows.filter(F.col("__size").isNotNull()).drop("__size")
             .withColumnRenamed(key, "__key")
             .repartition("__key", "__comp")
             .sortWithinPartitions("__key", "__comp", "arrival", "id")
             .mapInPandas(_fold_sorted, f"id {id_type}, ok boolean"))
    return small.unionByName(large)


def admit(requests: DataFrame, existing: DataFrame, products: DataFrame) -> DataFrame:
    """Decide every request: ``id, scope, admitted, reason, conflicting_promotion_id``."""
    req = requests.select("id", "scope", "target_product_id", "target_category_id",
                          "starts_at", "ends_at", "created_at", "arrival")
    cat_req = req.filter(F.col("scope") == "CATEGORY")
    prod_req = req.filter(F.col("scope") == "PRODUCT")

    # Conflicts with existing promotions, for both stages in one sweep: a
    # CATEGORY request is checked on its category key only (Q1), a PRODUCT
    # request on its product key and on its product's category key.
    pcat = products.select(F.col("id").alias("__pid"), F.col("category_id").alias("req_category_id"))
    prod_req_c = prod_req.join(pcat, prod_req["target_product_id"] == pcat["__pid"], "left").drop("__pid")
    probes = (cat_req.select("id", F.concat(F.lit("C|"), F.col("target_category_id").cast("string")).alias("__k"),
                             "starts_at", "ends_at")
              .unionByName(prod_req_c.select("id", F.concat(F.lit("P|"), F.col("target_product_id").cast("string"))
                                             .alias("__k"), "starts_at", "ends_at"))
              .unionByName(prod_req_c.select("id", F.concat(F.lit("C|"), F.col("req_category_id").cast("string"))
                                             .alias("__k"), "starts_at", "ends_at")))
    ex = existing.filter(rules.is_unfinished()).select(
        F.when(F.col("scope") == "PRODUCT", F.concat(F.lit("P|"), F.col("target_product_id").cast("string")))
         .otherwise(F.concat(F.lit("C|"), F.col("target_category_id").cast("string"))).alias("__exk"),
        F.col("starts_at").alias("__exs"), F.col("ends_at").alias("__exe"))
    blocked_existing = overlaps_any(probes, ex, "__k", "__exk", "starts_at", "ends_at", "__exs", "__exe")

    # Stage 1: free CATEGORY requests fold per category.
    cat_free = cat_req.join(blocked_existing, "id", "left_anti")
    # Cut lineage (reliable checkpoint): stage 2 and the reasons reuse it.
    cat_ok = _fold_by_key(cat_free, "target_category_id").filter("ok").select("id").checkpoint(eager=True)
    cat_admitted = cat_req.join(cat_ok, "id", "left_semi")

    # Stage 2: PRODUCT requests, also blocked by earlier admitted CATEGORY ones.
    # earlier-arrived admitted CATEGORY requests of the same category
    ca = cat_admitted.select(F.col("target_category_id").alias("__ck"),
                             F.col("starts_at").alias("__cs"), F.col("ends_at").alias("__ce"),
                             F.col("arrival").alias("__ca"), F.col("id").alias("__cid"))
    rq = prod_req_c.select(F.col("id").alias("__rid"), F.col("req_category_id").alias("__rk"),
                           F.col("starts_at").alias("__rs"), F.col("ends_at").alias("__re"),
                           F.col("arrival").alias("__ra"))
    earliest = earliest_overlap(
        rq.select(F.col("__rk").alias("key"), F.col("__rs").alias("start"), F.col("__re").alias("end"),
                  F.struct(F.col("__ra").alias("arrival"), F.col("__rid").alias("id")).alias("id")),
        ca.select(F.col("__ck").alias("key"), F.col("__cs").alias("start"), F.col("__ce").alias("end"), "__ca", "__cid"),
        {"blocker": F.struct(F.col("__ca").alias("arrival"), F.col("__cid").alias("id"))})
    b3 = earliest.filter(F.col("blocker") < F.col("id")).select("id.id")
    blocked = blocked_existing.unionByName(b3).distinct()
    prod_free = prod_req_c.join(blocked, "id", "left_anti")
    prod_ok = _fold_by_key(prod_free.drop("req_category_id"), "target_product_id").filter("ok").select("id")

    admitted_ids = cat_ok.unionByName(prod_ok)
    decided = req.join(admitted_ids.withColumn("admitted", F.lit(True)), "id", "left").withColumn(
        "admitted", F.coalesce(F.col("admitted"), F.lit(False))).checkpoint(eager=True)
    return _with_reasons(decided, existing, products)


def _with_reasons(decided: DataFrame, existing: DataFrame, products: DataFrame) -> DataFrame:
    """Reason and first blocker of each rejected request: existing unfinished
    promotions (always earlier) and admitted requests that arrived earlier."""
    adm = decided.filter("admitted")
    ex = existing.filter(rules.is_unfinished())
    blockers = (ex.select("id", "scope", "target_product_id", "target_category_id", "starts_at",
                          "ends_at", "created_at", F.lit(None).cast("long").alias("arrival"))
                .unionByName(adm.select("id", "scope", "target_product_id", "target_category_id",
                                        "starts_at", "ends_at", "created_at", "arrival")))
    rej = decided.filter(~F.col("admitted"))
    first = first_blockers(rej, blockers, products, order_col="arrival").drop("scope")
    return (decided.join(first, "id", "left")
            .select("id", "scope", "admitted", "reason", "conflicting_promotion_id"))


def _target_keys(df: DataFrame, cat_col: str) -> DataFrame:
    """(kind|key) rows a promotion is checked on: a PRODUCT request on its
    product and its product's category, a CATEGORY request on its category."""
    prod = df.filter(F.col("scope") == "PRODUCT")
    cat = df.filter(F.col("scope") == "CATEGORY")
    return (prod.withColumn("__kk", F.concat(F.lit("P|"), F.col("target_product_id").cast("string")))
            .unionByName(prod.withColumn("__kk", F.concat(F.lit("C|"), F.col(cat_col).cast("string"))))
            .unionByName(cat.withColumn("__kk", F.concat(F.lit("C|"), F.col("target_category_id").cast("string")))))


def first_blockers(candidates: DataFrame, blockers: DataFrame, products: DataFrame,
                   order_col: str) -> DataFrame:
    """W3 over a set: per candidate the first blocker that applies to its
    target, overlaps its window and precedes it (blocker ``order_col`` NULL,
    smaller, or equal with a smaller id).

    First is: the smallest (``order_col``, id) of those with an order, the
    oldest created_at, then id, of those without, and of these two the one
    with the older created_at. Returns ``id, scope, reason,
    conflicting_promotion_id`` for candidates with a hit. No pairs are made
    (``ranges.earliest_overlap``)."""
    pcat = products.select(F.col("id").alias("__pid"), F.col("category_id").alias("__pc"))
    c = candidates.select("id", "scope", "target_product_id", "target_category_id", "starts_at",
                          "ends_at", F.col(order_col).alias("__ord"))
    # CATEGORY candidates have no product: NULL keys skip the shuffle
    c = join_small(c, pcat, c["target_product_id"] == pcat["__pid"], "left",
                   big_key="target_product_id").drop("__pid")
    ck = _target_keys(c, "__pc").select("id", "scope", "starts_at", "ends_at", "__ord", "__kk")
    if "status" in blockers.columns:  # only ACTIVE/SCHEDULED promotions block
        blockers = blockers.filter(rules.is_unfinished())
    b = blockers.select(
        F.col("id").alias("__bid"), F.col("scope").alias("existing_scope"),
        F.when(F.col("scope") == "PRODUCT",
               F.concat(F.lit("P|"), F.col("target_product_id").cast("string")))
         .otherwise(F.concat(F.lit("C|"), F.col("target_category_id").cast("string"))).alias("__bkk"),
        F.col("starts_at").alias("__bs"), F.col("ends_at").alias("__be"),
        F.col("created_at").alias("existing_created_at"), F.col(order_col).alias("__bord"))
    # A blocker with an order value must come before the candidate; one without always does.
    oldest = [F.col("existing_created_at").isNull().alias("undated"), F.col("existing_created_at").alias("created"),
              F.col("__bid").alias("bid"), F.col("existing_scope").alias("existing_scope")]
    first = earliest_overlap(
        ck.select(F.col("__kk").alias("key"), F.col("starts_at").alias("start"), F.col("ends_at").alias("end"), "id"),
        b.select(F.col("__bkk").alias("key"), F.col("__bs").alias("start"), F.col("__be").alias("end"),
                 "__bid", "__bord", "existing_created_at", "existing_scope"),
        {"ordered": F.when(F.col("__bord").isNotNull(), F.struct(F.col("__bord").alias("ord"), F.col("__bid").alias("bid"),
                                                                F.struct(*oldest).alias("blocker"))),
         "standing": F.when(F.col("__bord").isNull(), F.struct(*oldest))})
    hit = c.select("id", "scope", "__ord").join(first, "id")
    before = (F.col("ordered.ord") < F.col("__ord")) | ((F.col("ordered.ord") == F.col("__ord"))
                                                        & (F.col("ordered.bid") < F.col("id")))
    blocker = F.array_min(F.filter(F.array(F.when(before, F.col("ordered.blocker")), F.col("standing")),
                                   lambda x: x.isNotNull()))
    hit = hit.withColumn("__blocker", blocker).filter(F.col("__blocker").isNotNull())
    hit = hit.select("id", "scope", F.col("__blocker.existing_scope").alias("existing_scope"),
                     F.col("__blocker.bid").alias("existing_id"))
    return hit.select("id", "scope", rules.conflict_reason().alias("reason"),
                      F.col("existing_id").alias("conflicting_promotion_id"))
