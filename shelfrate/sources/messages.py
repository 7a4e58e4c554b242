"""Chunk messages: decode JSON bodies, split good from dead-letter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_messages(df: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(good, dead_letter). Good rows get ``message`` (a variant) parsed from
    ``body``; a body that is not JSON goes to the dead-letter frame with the
    reason. One pass: both sides filter the same parsed column."""
    parsed = df.withColumn("__v", F.try_parse_json(F.col(body)))
    good = parsed.filter(F.col("__v").isNotNull()).withColumn(
        "message", F.struct(
            F.try_variant_get("__v", "$.k", "bigint").alias("k"),
            F.try_variant_get("__v", "$.batchId", "string").alias("batch_id"),
            F.try_variant_get("__v", "$.chunkKey", "string").alias("chunk_key"),
            F.try_variant_get("__v", "$.chunkIndex", "bigint").alias("chunk_index"))).drop("__v")
    dead = parsed.filter(F.col("__v").isNull()).drop("__v").withColumn("reason", F.lit("MALFORMED_JSON"))
    return good, dead
