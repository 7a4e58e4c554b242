"""Named queries over the driver tables: (spark, sf_dir) -> DataFrame.

Each entry composes library operators on the adapted driver tables; the
matching DuckDB SQL lives next to it so the two can be read side by side.
Timestamps leave as ISO-8601 text (the reference's wire format), money as
decimal(12,2) and counts as bigint, so both engines produce the same types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def iso(col) -> F.Column:
    """Timestamp -> ISO-8601 text with milliseconds and Z."""
    c = F.col(col) if isinstance(col, str) else col
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


ISO_SQL = "strftime({c}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


def iso_sql(c: str) -> str:
    return ISO_SQL.format(c=c)
