"""Instants as epoch microseconds, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType


def epoch_micros(df: DataFrame, col: str) -> Column:
    """Microseconds since 1970-01-01 of ``df[col]``.

    A naive timestamp (``timestamp_ntz``, as the driver tables carry) is
    converted arithmetically, never through the session time zone, so a
    non-UTC session with daylight-saving gaps cannot reorder or merge
    instants; an aware ``timestamp`` uses ``unix_micros``.
    """
    if isinstance(df.schema[col].dataType, TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{col}`)")
    return F.unix_micros(F.col(col))
