"""Joins of [start, end) windows on a key.

``overlap_join`` gives all pairs, by dyadic covers of time buckets: a window
of any length is a few rows. ``earliest_overlap`` gives each window the first
of the windows it overlaps, without making pairs: the sorted line of all
starts and ends is cut into blocks, a block answers for its own places, and
whole blocks meet as dyadic nodes.
``overlaps_any`` only tells whether there is one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from shelfrate.functions.timeutil import epoch_micros
from shelfrate.plans.dyadic import cover, levels_in, nodes_of
from shelfrate.plans.joins import join_small
from shelfrate.plans.ordering import global_row_number, range_partition

# With two days, timestamps of the years 1 to 9999 need 21 levels: at most 42 rows for a window and 21 for its start.
DEFAULT_BUCKET_SECONDS = 2 * 86400
# Places of the sorted line that a task answers for at a time.
BLOCK = 1 << 14


def _micros(df: DataFrame, col: str) -> Column:
    """Epoch microseconds of an instant, or of a column that holds them already."""
    return F.col(col) if dict(df.dtypes)[col] == "bigint" else epoch_micros(df, col)


def _bucket_of(micros: Column, width: int) -> Column:
    return F.floor(micros / F.lit(width * 1_000_000)).cast("bigint")


def cover_rows(df: DataFrame, start: str, end: str, width: int = DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """One row for each dyadic node of the time buckets that a window touches (``__level``, ``__node``)."""
    first = _bucket_of(_micros(df, start), width)
    # end is exclusive: the last touched bucket is the one of (end - 1 us)
    last = F.greatest(first, _bucket_of(_micros(df, end) - F.lit(1), width))
    return (df.withColumn("__n", F.explode(cover(first, last)))
            .withColumn("__level", F.col("__n.level")).withColumn("__node", F.col("__n.node")).drop("__n"))


def _start_rows(df: DataFrame, start: str, levels: list[int], width: int) -> DataFrame:
    point = _bucket_of(_micros(df, start), width)
    return (df.withColumn("__n", F.explode(nodes_of(point, levels)))
            .withColumn("__at_level", F.col("__n.level")).withColumn("__at_node", F.col("__n.node")).drop("__n"))


def overlap_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                 left_start: str, left_end: str, right_start: str, right_end: str,
                 bucket_seconds: int = DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """Pairs (l, r) with l[left_key] == r[right_key] and overlapping windows.

    Of two overlapping windows one holds the start of the other. So each
    side's covers meet the other side's starts: on (key, level, node), which
    spreads a key over as many tasks as its timeline has nodes. A pair comes
    from the side that starts first (from the left at equal starts), once.
    Column names of ``left`` and ``right`` must be disjoint.
    """
    overlap = ((F.col(left_start) < F.col(right_end)) & (F.col(right_start) < F.col(left_end)))
    from_left = _starts_inside(left, right, left_key, right_key, left_start, left_end, right_start, bucket_seconds)
    from_right = _starts_inside(right, left, right_key, left_key, right_start, right_end, left_start, bucket_seconds)
    return (from_left.filter(overlap & (F.col(left_start) <= F.col(right_start)))
            .unionByName(from_right.filter(overlap & (F.col(right_start) < F.col(left_start)))))


def _starts_inside(outer: DataFrame, inner: DataFrame, outer_key: str, inner_key: str, outer_start: str,
                   outer_end: str, inner_start: str, width: int) -> DataFrame:
    covers = cover_rows(outer, outer_start, outer_end, width)
    levels = levels_in(covers.select(F.col("__level").alias("level")))
    starts = _start_rows(inner, inner_start, levels, width)
    cond = ((covers[outer_key] == starts[inner_key]) & (covers["__level"] == starts["__at_level"])
            & (covers["__node"] == starts["__at_node"]))
    return covers.join(starts, cond).drop("__level", "__node", "__at_level", "__at_node")


def earliest_overlap(candidates: DataFrame, blockers: DataFrame, ranks: dict[str, Column]) -> DataFrame:
    """``id`` of every candidate that overlaps a blocker, with the smallest of each of the ``ranks`` among these.

    ``candidates`` is (key, start, end, id), ``blockers`` (key, start, end)
    and the columns of the rank expressions. A candidate's id may come with
    several keys. Windows that do not end after they start, which validation
    refuses, are paired by ``overlap_join``.

    All starts and ends are numbered along one line, sorted by key and time,
    at equal times: blocker ends, candidates, blocker starts. A blocker that
    overlaps either starts inside the candidate or holds its start. The line
    is cut into blocks of ``BLOCK`` places: a window is one or two rows there,
    and a task answers for one block at a time (``_in_block``). The whole
    blocks between a window's two ends are dyadic nodes over the blocks: the
    smallest rank of the starts in a node for candidates, and for blockers
    the smallest rank of each block, which comes into the block as one more
    row. So a window is few rows, nothing grows with how many windows meet,
    and numbers lie evenly however the windows are spread over keys and time.

    Ranks travel as numbers in their order, and are looked up at the end.
    """
    names = list(ranks)
    numbers = [f"__r{i}" for i in range(len(names))]
    c = candidates.select(F.col("key").alias("__key"), _micros(candidates, "start").alias("__s"),
                          _micros(candidates, "end").alias("__e"), F.col("id").alias("__id"))
    b = blockers.select(F.col("key").alias("__key"), _micros(blockers, "start").alias("__s"),
                        _micros(blockers, "end").alias("__e"), *[v.alias(n) for n, v in ranks.items()])
    b = b.filter(F.col("__key").isNotNull() & F.col("__s").isNotNull() & F.col("__e").isNotNull())
    lookups = []
    for n, number in zip(names, numbers, strict=True):
        # Rows without a rank are left out of the sort: they would all lie in one range.
        some = global_row_number(b.filter(F.col(n).isNotNull()), [F.col(n)], out=number)
        lookups.append(some.select(number, n))
        b = some.drop(n).unionByName(b.filter(F.col(n).isNull()).drop(n).withColumn(number, F.lit(None).cast("long")))
    b = b.withColumn("__id", F.lit(None).cast(dict(c.dtypes)["__id"]))
    c = c.filter(F.col("__key").isNotNull() & F.col("__s").isNotNull() & F.col("__e").isNotNull())
    c = c.select("*", *[F.lit(None).cast("long").alias(r) for r in numbers])
    rows = c.withColumn("__side", F.lit(1)).unionByName(b.withColumn("__side", F.lit(0)))
    every = rows.withColumn("__row", F.monotonically_increasing_id()).checkpoint(eager=True)
    rows, malformed = every.filter("__s < __e"), every.filter("__s >= __e")
    kind = F.when(F.col("__side") == 1, F.lit(1))
    events = rows.select("__row", "__key", F.explode(F.array(
        F.struct(F.col("__s").alias("t"), kind.otherwise(F.lit(2)).alias("kind")),
        F.struct(F.col("__e").alias("t"), kind.otherwise(F.lit(0)).alias("kind")))).alias("ev"))
    events = events.select("__row", "__key", "ev.t", "ev.kind")
    numbered = global_row_number(events, [F.col("__key"), F.col("t"), F.col("kind"), F.col("__row")], out="__n")
    ends = numbered.groupBy("__row").agg(F.min("__n").alias("__first"), F.max("__n").alias("__last"))
    block_of = lambda c: F.floor(F.col(c) / F.lit(BLOCK)).cast("bigint")
    placed = rows.join(ends, "__row").select(
        "__side", "__id", "__first", "__last", block_of("__first").alias("__fb"), block_of("__last").alias("__lb"),
        *numbers).checkpoint(eager=True)
    cand, block = placed.filter("__side = 1"), placed.filter("__side = 0")

    smallest = [F.min(r).alias(r) for r in numbers]
    whole = cover(F.col("__fb") + 1, F.col("__lb") - 1)
    spread = lambda df, nodes, cols: df.select(*cols, F.explode(nodes).alias("x")).select(
        *cols, "x.level", "x.node")
    across = lambda df: df.filter("__lb > __fb + 1")
    ranges = spread(across(cand), whole, ["__id"])
    fewer = block.groupBy("__fb").agg(*smallest).checkpoint(eager=True)  # one row a block at most
    starts = spread(fewer, nodes_of(F.col("__fb"), levels_in(ranges)), numbers).groupBy("level", "node").agg(*smallest)
    covers = spread(across(block), whole, numbers).groupBy("level", "node").agg(*smallest).checkpoint(eager=True)
    held = (spread(cand.select("__fb").distinct(), nodes_of(F.col("__fb"), levels_in(covers)), ["__fb"])
            .join(covers, ["level", "node"]).groupBy("__fb").agg(*smallest))

    low, high = F.col("__first") % BLOCK, F.col("__last") % BLOCK
    piece = lambda at, first, last, start: F.struct(
        at.alias("__block"), first.cast("int").alias("__a"), last.cast("int").alias("__b"), start.cast("int").alias("__p"))
    alone = F.col("__fb") == F.col("__lb")
    pieces = F.array(piece(F.col("__fb"), low + 1, F.when(alone, high - 1).otherwise(BLOCK - 1), low),
                     F.when(~alone, piece(F.col("__lb"), F.lit(0), high - 1, F.lit(-1))))
    parts = (placed.select("__side", "__id", *numbers, F.explode(F.filter(pieces, lambda x: x.isNotNull())).alias("x"))
             .select("x.*", "__side", "__id", *numbers))
    parts = parts.unionByName(held.select(
        F.col("__fb").alias("__block"), F.lit(0).alias("__a"), F.lit(BLOCK - 1).alias("__b"), F.lit(-1).alias("__p"),
        F.lit(0).alias("__side"), F.lit(None).cast(dict(c.dtypes)["__id"]).alias("__id"), *numbers))
    found = StructType([StructField("__id", c.schema["__id"].dataType), *[StructField(r, LongType()) for r in numbers]])
    hits = (parts.groupBy("__block").applyInArrow(_in_block(numbers), found)
            .unionByName(join_small(ranges, starts, ["level", "node"], "inner").select("__id", *numbers)))
    if not malformed.isEmpty():
        hits = hits.unionByName(_malformed_pairs(rows, malformed, numbers))
    out = hits.groupBy(F.col("__id").alias("id")).agg(*smallest)
    for number, lookup in zip(numbers, lookups, strict=True):
        out = out.join(lookup, number, "left").drop(number)
    return out.select("id", *names)


def _in_block(numbers: list[str]):
    """Smallest ranks of a block's candidates.

    A row is the part ``__a``..``__b`` of a window that lies in the block (none
    if ``__b`` is smaller), and the place ``__p`` of its start, -1 if that lies
    before. Two sparse tables over the places: the smallest rank of the
    starts in a span, and of the blockers that hold a place.
    """
    none = np.iinfo(np.int64).max

    def run(table: pa.Table) -> pa.Table:
        side, a, b, p = (table.column(n).to_numpy() for n in ("__side", "__a", "__b", "__p"))
        size = b.astype(np.int64) - a + 1
        level = np.where(size > 0, np.frexp(np.maximum(size, 1).astype(float))[1] - 1, -1)
        is_cand, best = side == 1, {}
        for r in numbers:
            rank = pc.fill_null(table.column(r), none).to_numpy()
            top = BLOCK.bit_length()
            starting = np.full((top, BLOCK), none)
            begins = np.flatnonzero(~is_cand & (p >= 0))
            starting[0][p[begins]] = rank[begins]
            for k in range(1, top):
                half = 1 << (k - 1)
                starting[k] = starting[k - 1]
                np.minimum(starting[k - 1][:-half], starting[k - 1][half:], out=starting[k][:-half])
            holding = np.full((top, BLOCK), none)
            held = np.flatnonzero(~is_cand & (size > 0))
            np.minimum.at(holding, (level[held], a[held]), rank[held])
            np.minimum.at(holding, (level[held], b[held] + 1 - (1 << level[held])), rank[held])
            for k in range(top - 1, 0, -1):
                half = 1 << (k - 1)
                np.minimum(holding[k - 1], holding[k], out=holding[k - 1])
                np.minimum(holding[k - 1][half:], holding[k][:-half], out=holding[k - 1][half:])
            low = np.full(len(side), none)
            asks = np.flatnonzero(is_cand & (size > 0))
            low[asks] = np.minimum(starting[level[asks], a[asks]],
                                   starting[level[asks], b[asks] + 1 - (1 << level[asks])])
            points = np.flatnonzero(is_cand & (p >= 0))
            low[points] = np.minimum(low[points], holding[0][p[points]])
            best[r] = low
        hit = np.flatnonzero(np.min([best[r] for r in numbers], axis=0) < none)
        found = [pa.array(best[r][hit], mask=best[r][hit] == none) for r in numbers]
        return pa.Table.from_arrays([table.column("__id").take(pa.array(hit)), *found], names=["__id", *numbers])
    return run


def _malformed_pairs(rows: DataFrame, malformed: DataFrame, names: list[str]) -> DataFrame:
    """(__id, ranks) of the overlaps in which a window does not end after its start."""
    def pairs(cand: DataFrame, block: DataFrame) -> DataFrame:
        block = block.filter("__side = 0").select(
            F.col("__key").alias("__bk"), F.col("__s").alias("__bs"), F.col("__e").alias("__be"), *names)
        cand = cand.filter("__side = 1").select("__id", "__key", "__s", "__e")
        return overlap_join(cand, block, "__key", "__bk", "__s", "__e", "__bs", "__be").select("__id", *names)

    return pairs(malformed, rows.unionByName(malformed)).unionByName(pairs(rows, malformed))


def overlaps_any(candidates: DataFrame, blockers: DataFrame, cand_key: str, block_key: str,
                 cand_start: str, cand_end: str, block_start: str, block_end: str,
                 cand_id: str = "id", num_partitions: int | None = None) -> DataFrame:
    """Ids of candidates whose [start, end) overlaps at least one blocker
    window on the same key — without producing pairs.

    Overlap with some blocker <=> max(blocker end | blocker start < cand end)
    > cand start. Both sides become events on one sorted line per key
    (blockers at their start carrying their end, candidates at their end
    carrying their start; a candidate sorts before a blocker at the same
    point), and one running max answers every candidate. The scan is
    distributed like ``ordering.interval_components``: range partitions,
    one pass per task, a carry per partition for keys that cross a
    boundary. Work is linear in both sides however dense a key is.
    """
    from pyspark.sql.types import StructField, StructType

    spark = candidates.sparkSession
    n = num_partitions  # None: shuffle partitions, coalesced by AQE to the data size
    key_t = candidates.schema[cand_key].dataType
    ev_c = candidates.select(F.col(cand_key).cast(key_t).alias("__k"), epoch_micros(candidates, cand_end).alias("__p"),
                             F.lit(0).alias("__kind"), epoch_micros(candidates, cand_start).alias("__v"),
                             F.col(cand_id).alias("__id"))
    id_t = ev_c.schema["__id"].dataType
    ev_b = blockers.select(F.col(block_key).cast(key_t).alias("__k"), epoch_micros(blockers, block_start).alias("__p"),
                           F.lit(1).alias("__kind"), epoch_micros(blockers, block_end).alias("__v"),
                           F.lit(None).cast(id_t).alias("__id"))
    order = [F.col("__k"), F.col("__p"), F.col("__kind")]
    events = ev_c.unionByName(ev_b).filter(F.col("__k").isNotNull())
    fixed = (range_partition(events, n, order).sortWithinPartitions(*order)
             .withColumn("__pid", F.spark_partition_id()).checkpoint(eager=True))

    def summarize(batches):
        import pandas as pd
        pid = None
        first = last = run = None
        single, seen = True, False
        for b in batches:
            if pid is None and len(b):
                pid = int(b["__pid"].iloc[0])
            for k, kind, v in zip(b["__k"], b["__kind"], b["__v"]):
                if not seen:
                    first, seen = k, True
                if last is None or k != last:
                    single = single and last is None
                    last, run = k, None
                if kind == 1:
                    run = int(v) if run is None else max(run, int(v))
        if seen:
            yield pd.DataFrame({"pid": [pid], "first_key": [first], "last_key": [last],
                                "seg_max": [run], "single": [single]})

    kt = key_t.simpleString()
    rows = sorted(fixed.mapInPandas(summarize, f"pid int, first_key {kt}, last_key {kt}, seg_max long, "
                                               f"single boolean").collect(), key=lambda r: r["pid"])
    carries, state = {}, None
    for r in rows:  # one row per partition
        if state is not None and state[0] == r["first_key"]:
            carries[r["pid"]] = state[1]
            if r["single"]:
                m = [x for x in (state[1], r["seg_max"]) if x is not None]
                state = (r["last_key"], max(m) if m else None)
                continue
        state = (r["last_key"], r["seg_max"])
    bc = spark.sparkContext.broadcast(carries)

    def probe(batches):
        import pandas as pd
        cur, run = None, None
        first_row = True
        for b in batches:
            if first_row and len(b):
                pid = int(b["__pid"].iloc[0])
                if pid in bc.value:
                    cur, run = "__carry__", bc.value[pid]
            ids = []
            for k, kind, v, i in zip(b["__k"], b["__kind"], b["__v"], b["__id"]):
                if first_row and cur == "__carry__":
                    cur, first_row = k, False
                elif cur is None or k != cur:
                    cur, run = k, None
                first_row = False
                if kind == 1:
                    run = int(v) if run is None else max(run, int(v))
                elif run is not None and run > v:
                    ids.append(i)
            if ids:
                yield pd.DataFrame({"id": ids})

    return fixed.mapInPandas(probe, StructType([StructField("id", id_t, True)]))
