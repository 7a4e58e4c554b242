"""Distributed global row numbering (no single-partition window).

``row_number() over (order by ...)`` without ``partitionBy`` moves every
row into one task. Instead: range-partition and sort, checkpoint so the
partition layout is fixed, count rows per partition (one small row per
partition), turn the counts into start offsets and add them to the
position inside the partition. Work stays spread over all tasks; only the
per-partition counts (bounded by the partition count) reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from shelfrate.functions.timeutil import epoch_micros
from shelfrate.plans.joins import join_small


def range_partition(df: DataFrame, n: int | None, order: list[Column]) -> DataFrame:
    """Range-partition on ``order``; without an explicit count the shuffle
    partition setting applies and AQE coalesces small partitions (the
    partition index is recorded in the rows afterwards, so coalescing is
    harmless)."""
    return df.repartitionByRange(n, *order) if n else df.repartitionByRange(*order)


def global_row_number(df: DataFrame, order: list[Column], out: str = "rn",
                      num_partitions: int | None = None) -> DataFrame:
    """Add a 1-based row number ``out`` following ``order`` over the whole frame."""
    spark = df.sparkSession
    n = num_partitions  # None: shuffle partitions, coalesced by AQE to the data size
    sorted_df = (range_partition(df, n, order).sortWithinPartitions(*order)
                 .withColumn("__pid", F.spark_partition_id())
                 .withColumn("__mid", F.monotonically_increasing_id()))
    # Fix the layout: ids and partition counts must come from one evaluation.
    fixed = sorted_df.checkpoint(eager=True)
    counts = fixed.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"),
                                        F.min("__mid").alias("__first"))
    rows = sorted(counts.collect(), key=lambda r: r["__pid"])  # one row per partition
    offsets, acc = [], 0
    for r in rows:
        offsets.append((r["__pid"], acc, r["__first"]))
        acc += r["__n"]
    off_df = spark.createDataFrame(offsets, "__pid int, __off long, __first long")
    j = join_small(fixed, off_df, "__pid", "inner")
    return (j.withColumn(out, F.col("__mid") - F.col("__first") + F.col("__off") + F.lit(1))
             .drop("__pid", "__mid", "__off", "__first"))


def interval_components(df: DataFrame, key: str, start: str, end: str, tiebreak: str,
                        out: str = "__comp", num_partitions: int | None = None) -> DataFrame:
    """Label time-connected components of [start, end) windows per ``key``.

    A window opens a new component when it starts at or after the end of
    every earlier window of its key (sorted by start, end, tiebreak); the
    label is the (start, tiebreak) of the window that opened it, as text.

    Distributed prefix scan instead of a per-key window: range-partition on
    (key, start, ...) so a hot key spreads over many tasks; each task scans
    its sorted rows once (Arrow batches, constant memory); only keys that
    cross a partition boundary need a carry, so one summary row per
    partition goes to the driver and the carries come back as a small map.
    """
    spark = df.sparkSession
    n = num_partitions  # None: shuffle partitions, coalesced by AQE to the data size
    order = [F.col(key), F.col("__s"), F.col("__e"), F.col(tiebreak)]
    prepared = (df.withColumn("__s", epoch_micros(df, start))
                  .withColumn("__e", epoch_micros(df, end)))
    # The partition index is stored in the rows: a task's own partition id
    # is not stable once the frame is unioned with others downstream.
    fixed = (range_partition(prepared, n, order).sortWithinPartitions(*order)
             .withColumn("__pid", F.spark_partition_id()).checkpoint(eager=True))
    key_type = fixed.schema[key].dataType.simpleString()

    def summarize(batches):
        # Local scan from no carry. Reports the first key, whether the whole
        # partition is one key, and for the last key's segment: its max end
        # and the last window that opened a component (marker and start).
        import pandas as pd
        pid = None
        first_key = last_key = run_max = marker = opener_s = None
        single, seen = True, False
        for b in batches:
            if pid is None and len(b):
                pid = int(b["__pid"].iloc[0])
            for k, s, e, t in zip(b[key], b["__s"], b["__e"], b[tiebreak]):
                if not seen:
                    first_key, seen = k, True
                if last_key is None or k != last_key:
                    single = single and last_key is None
                    last_key, run_max, marker = k, None, None
                if run_max is None or s >= run_max:
                    marker, opener_s = f"{s}:{t}", int(s)
                run_max = int(e) if run_max is None else max(run_max, int(e))
        if seen:
            yield pd.DataFrame({"pid": [pid], "first_key": [first_key], "last_key": [last_key],
                                "seg_max": [run_max], "marker": [marker], "opener_s": [opener_s],
                                "single": [single]})

    summ_schema = (f"pid int, first_key {key_type}, last_key {key_type}, seg_max long, "
                   f"marker string, opener_s long, single boolean")
    rows = sorted(fixed.mapInPandas(summarize, summ_schema).collect(), key=lambda r: r["pid"])
    # Carry into each partition whose first key continues from earlier ones.
    # With a carry (M, mk), a local opener stays an opener iff its start >= M;
    # starts grow within a key, so only the last local opener needs checking.
    carries: dict[int, tuple] = {}
    state = None  # (key, max end, marker) after all earlier partitions
    for r in rows:
        if state is not None and state[0] == r["first_key"]:
            carries[r["pid"]] = state
            if r["single"]:
                m_in, mk_in = state[1], state[2]
                mk = r["marker"] if r["opener_s"] >= m_in else mk_in
                state = (r["last_key"], max(m_in, r["seg_max"]), mk)
                continue
        state = (r["last_key"], r["seg_max"], r["marker"])
    bc = spark.sparkContext.broadcast(carries)  # at most one entry per partition

    def label(batches):
        cur_key = run_max = marker = None
        started = False
        for b in batches:
            if not started and len(b):
                started = True
                c = bc.value.get(int(b["__pid"].iloc[0]))
                if c is not None:
                    cur_key, run_max, marker = c
            labels = []
            for k, s, e, t in zip(b[key], b["__s"], b["__e"], b[tiebreak]):
                if cur_key is None or k != cur_key:
                    cur_key, run_max, marker = k, None, None
                if run_max is None or s >= run_max:
                    marker = f"{s}:{t}"
                run_max = e if run_max is None else max(run_max, e)
                labels.append(marker)
            yield b.assign(**{out: labels})

    out_schema = StructType(list(fixed.schema.fields) + [StructField(out, StringType(), True)])
    return fixed.mapInPandas(label, out_schema).drop("__s", "__e", "__pid")
