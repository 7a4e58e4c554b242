"""Feed files with quoted line breaks, read in splits.

Spark's multi-line CSV reader parses a whole file in one task. Here the file
is read as text, in splits, and the quotes decide which physical lines make a
record: a line starts a record if an even number of quotes stands before it
in its file.

1. Each split counts its quotes and, for both states that it may begin in
   (outside or inside a quoted cell), the records that start in it.
2. A prefix scan over the splits of a file (one small row for each) gives the
   true state and the record number at which each split begins.
3. Lines that are a record by themselves are parsed where they are; only the
   lines of records with line breaks are shuffled, keyed by file and record.

Headers are the first records, found in the same scan; the driver sees the
distinct header lines only, and makes no call for each file.

Edge cases: blank lines between records are skipped, inside quotes they are
kept; a byte-order mark is removed; a file without records gives no rows; a
record with a wrong number of cells is kept and marked; a record with a quote
that is never closed reaches to the end of its file, as in the multi-line
reader; a quote inside an unquoted cell counts as a quote (RFC 4180 allows none).
"""

from __future__ import annotations

import csv
import io

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from shelfrate.plans.joins import join_small
from shelfrate.schemas import FEED_COLUMNS
from shelfrate.session import ship_package
from shelfrate.sources.feed_csv import CORRUPT, CSV_OPTIONS, canonical_path, glob_safe

_KEYS = ["source_file", "block"]
# State before the line (1: inside quotes), records started up to it, if the split begins outside or inside quotes.
_SCANNED = "inside int, starts0 long, starts1 long"


def _lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """(source_file, block, at, quotes, blank, text) of every physical line; ``at`` orders the lines of a split."""
    text = F.regexp_replace("value", "^﻿", "")
    return (spark.read.option("lineSep", "\n").text([glob_safe(f) for f in files])
            .select(canonical_path(F.col("_metadata.file_path")).alias("source_file"),
                    F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
                    (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"),
                    text.rlike(r"^\s*$").alias("blank"), text.alias("text")))


def _scan(batches):
    """One pass over the lines of a task: running parity and record starts within each split."""
    state: dict[tuple, tuple] = {}
    for pdf in batches:
        inside = np.zeros(len(pdf), np.int32)
        starts = np.zeros((2, len(pdf)), np.int64)
        for key, rows in pdf.groupby(_KEYS, sort=False).indices.items():
            parity, n = state.get(key, (0, (0, 0)))
            odd = pdf["quotes"].to_numpy()[rows] & 1
            after = (np.cumsum(odd) + parity) & 1
            before = after ^ odd
            begins = ~pdf["blank"].to_numpy().astype(bool)[rows]
            inside[rows] = before
            for p in (0, 1):
                starts[p, rows] = np.cumsum((before == p) & begins) + n[p]
            state[key] = (int(after[-1]), (int(starts[0, rows[-1]]), int(starts[1, rows[-1]])))
        yield pdf.assign(inside=inside, starts0=starts[0], starts1=starts[1])


def _scanned(lines: DataFrame) -> DataFrame:
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lines.schema) + ", " + _SCANNED
    return lines.mapInPandas(_scan, schema)


def _split_starts(lines: DataFrame) -> DataFrame:
    """(source_file, block, open, first): state and record number at which each split begins."""
    splits = (_scanned(lines.drop("text")).groupBy(*_KEYS)
              .agg((F.sum("quotes") % 2).alias("odd"), F.max("starts0").alias("n0"), F.max("starts1").alias("n1")))
    earlier = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return (splits.withColumn("open", (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).cast("int"))
            .withColumn("n", F.when(F.col("open") == 0, F.col("n0")).otherwise(F.col("n1")))
            .select(*_KEYS, "open", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first")))


def read_records(spark: SparkSession, files: list[str]) -> DataFrame:
    """(source_file, record, text): the records of CSV files, numbered from 0 in each file, line breaks kept."""
    ship_package(spark)
    lines = _lines(spark, files)
    placed = join_small(_scanned(lines), _split_starts(lines), _KEYS, "inner")
    inside = F.col("inside").bitwiseXOR(F.col("open")) == 1
    started = F.when(F.col("open") == 0, F.col("starts0")).otherwise(F.col("starts1"))
    placed = (placed.where(inside | ~F.col("blank"))
              .select("source_file", (F.col("first") + started - 1).alias("record"), "block", "at", "text",
                      (~inside & (F.col("quotes") % 2 == 0)).alias("alone")))
    alone = placed.where("alone").select("source_file", "record", "text")
    ordered = F.array_sort(F.collect_list(F.struct("block", "at", "text")))
    joined = (placed.where("NOT alone").groupBy("source_file", "record")
              .agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text")))
    out = alone.unionByName(joined)
    # The carriage return of a line end is no part of the last cell.
    return out.withColumn("text", F.regexp_replace("text", "\r$", ""))


def _parsed(names: list[str], columns: tuple[str, ...]) -> Column:
    """Struct of ``columns`` and the corrupt record, parsed from ``text`` under one header."""
    cells = StructType([StructField(f"c{i}", StringType()) for i in range(len(names))]
                       + [StructField(CORRUPT, StringType())])
    options = {**{k: v for k, v in CSV_OPTIONS.items() if k != "header"}, "multiLine": "true"}
    row = F.from_csv("text", cells.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options)
    at = {c: i for i, c in enumerate(names)}
    # A present column has '' for an empty cell, an absent one NULL.
    return F.struct(*[F.coalesce(row[f"c{at[c]}"], F.lit("")).alias(c) if c in at
                      else F.lit(None).cast("string").alias(c) for c in columns], row[CORRUPT].alias(CORRUPT))


def read_quoted_feed(spark: SparkSession, files: list[str], columns: tuple[str, ...] = FEED_COLUMNS) -> DataFrame:
    """``source_file, row_index, <columns>, _corrupt_record`` of CSV files whose cells may hold line breaks."""
    records = read_records(spark, files)
    heads = records.where("record = 0").select("source_file", F.col("text").alias("header"))
    found = sorted(r.header for r in heads.select("header").distinct().collect())
    parsed = F.lit(None)
    for i, header in enumerate(found):
        names = [c.strip() for c in next(csv.reader(io.StringIO(header), skipinitialspace=True))]
        parsed = F.when(F.col("_head") == i, _parsed(names, columns)).otherwise(parsed)
    if not found:
        return spark.createDataFrame([], StructType(
            [StructField("source_file", StringType()), StructField("row_index", LongType())]
            + [StructField(c, StringType()) for c in (*columns, CORRUPT)]))
    number = F.lit(0)
    for i, header in enumerate(found[1:], 1):
        number = F.when(F.col("header") == header, i).otherwise(number)
    rows = records.where("record > 0")
    if len(found) > 1:
        rows = join_small(rows, heads.select("source_file", number.alias("_head")), ["source_file"], "inner")
    else:
        rows = rows.withColumn("_head", F.lit(0))
    return (rows.withColumn("_row", parsed)
            .select("source_file", (F.col("record") - 1).alias("row_index"), "_row.*"))
