"""Streaming counters (T6): labelled counts and weighted sums over an event
stream, kept in Spark state and emitted in update mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_counters(events: DataFrame, labels: list[str], weight: str | None = None) -> DataFrame:
    """Running count (or weighted sum) per label set; use outputMode("update")."""
    agg = (F.sum(F.col(weight)) if weight else F.count(F.lit(1))).cast("bigint").alias("value")
    return events.groupBy(*labels).agg(agg)


def start_counter_query(events: DataFrame, labels: list[str], sink, checkpoint: str,
                        weight: str | None = None, available_now: bool = True):
    """Run the counters with ``foreachBatch(sink)`` (e.g. write the current
    values of the updated labels to a table)."""
    w = (stream_counters(events, labels, weight).writeStream.outputMode("update")
         .foreachBatch(sink).option("checkpointLocation", checkpoint))
    return (w.trigger(availableNow=True) if available_now else w).start()
