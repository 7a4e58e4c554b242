"""Operational rollups over event rows: counters and histograms.

Every rollup is one hash aggregation with map-side partial combine, so a
label holding a third of all events costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

# Fixed values (must equal the reference's): histogram buckets (seconds)
# and the request paths the latency histogram ignores.
HTTP_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5)
MATERIALIZATION_BUCKETS = (0.01, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30)
IGNORED_PATHS = ("/metrics", "/health", "/ready")
UNMATCHED_ROUTE = "unmatched"


def counter(events: DataFrame, labels: list[str], weight: str | None = None) -> DataFrame:
    """Count (or weighted sum) per label set."""
    agg = (F.sum(F.col(weight)) if weight else F.count(F.lit(1))).cast("bigint").alias("value")
    return events.groupBy(*labels).agg(agg)


def histogram(events: DataFrame, labels: list[str], value: str, buckets=HTTP_BUCKETS) -> DataFrame:
    """Cumulative bucket counts (``le``), count and sum per label set.

    One aggregation computes every bucket (count_if per bound), then
    ``stack`` turns the bucket columns into rows (``le`` as text, '+Inf'
    last)."""
    v = F.col(value)
    vt = events.schema[value].dataType
    total = F.sum(v)
    if isinstance(vt, DecimalType):  # exact sum, widest decimal of the same scale
        total = total.cast(DecimalType(38, vt.scale))
    aggs = [F.count_if(v <= F.lit(b)).alias(f"__b{i}") for i, b in enumerate(buckets)]
    aggs += [F.count(F.lit(1)).alias("count"), total.alias("sum")]
    wide = events.groupBy(*labels).agg(*aggs)
    les = [_le_text(b) for b in buckets] + ["+Inf"]
    cols = [f"__b{i}" for i in range(len(buckets))] + ["count"]
    stack = "stack({n}, {pairs}) as (le, bucket_count)".format(
        n=len(les), pairs=", ".join(f"'{le}', {c}" for le, c in zip(les, cols)))
    return (wide.select(*labels, "count", "sum", F.expr(stack))
            .select(*labels, "le", F.col("bucket_count").cast("bigint").alias("bucket_count"),
                    F.col("count").cast("bigint").alias("count"), "sum"))


def _le_text(b) -> str:
    return repr(float(b)) if not float(b).is_integer() else str(int(b))


def request_log_filter(requests: DataFrame, path: str = "path") -> DataFrame:
    """Drop scrape/probe paths."""
    return requests.filter(~F.col(path).isin(*IGNORED_PATHS))


def route_label(route: Column) -> Column:
    return F.coalesce(route, F.lit(UNMATCHED_ROUTE))
