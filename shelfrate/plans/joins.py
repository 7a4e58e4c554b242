"""Join strategies with an explicit, measured size check.

``broadcast()`` is only used for a side whose row count was measured below
a bound; beyond it the join falls back to a shuffle join, optionally salted
so that one hot key on the large side spreads over several tasks. AQE's
skew-join split stays on as a second line of defence.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Rows we are willing to replicate to every executor. A per-category or
# per-promotion summary row is ~100 bytes, so this is ~20 MB at most.
DEFAULT_BROADCAST_ROWS = 200_000
DEFAULT_BROADCAST_BYTES = 64 * 2**20


_MEASURED: list[DataFrame] = []


def measure(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
            max_bytes: int = DEFAULT_BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """Check the exact size of a (reduced) side against a bound of rows and bytes.

    At most ``max_rows`` + 1 rows are computed and cached; only a side within
    both bounds stays cached, so that the join that follows reads it instead
    of reducing its source again. A larger side is returned as it came, with
    nothing kept. ``release_measured()`` unpersists at the end of a job.
    Returns (frame, fits bound).
    """
    head = df.limit(max_rows + 1).persist(StorageLevel.MEMORY_AND_DISK)
    if head.count() <= max_rows and _cached_bytes(head) <= max_bytes:
        _MEASURED.append(head)
        return head, True
    head.unpersist()
    return df, False


def _cached_bytes(df: DataFrame) -> int:
    """Bytes of a frame that has been cached in full."""
    return int(df.select("*")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def driver_rows(spark: SparkSession, rows: list, schema: StructType | str) -> DataFrame:
    """Rows that the driver holds, as a frame for joins, broadcast within the bound of rows.

    Their number is known, so unlike ``measure`` this needs no job, and as a
    local table they need no Python worker either.
    """
    schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    types = to_arrow_schema(schema)
    columns = zip(*rows, strict=True) if rows else [()] * len(types)
    df = spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, types, strict=True)], schema=types), schema)
    return F.broadcast(df) if len(rows) <= DEFAULT_BROADCAST_ROWS else df


def persist_for_job(df: DataFrame) -> DataFrame:
    """Cache a frame that a plan reads several times (released with the
    measured sides by ``release_measured``)."""
    fixed = df.persist(StorageLevel.MEMORY_AND_DISK)
    _MEASURED.append(fixed)
    return fixed


def release_measured() -> None:
    """Unpersist every side cached by ``measure`` (call when a job ends)."""
    while _MEASURED:
        _MEASURED.pop().unpersist()


def join_small(big: DataFrame, small: DataFrame, on, how: str = "left",
               max_rows: int = DEFAULT_BROADCAST_ROWS, salt_buckets: int = 0,
               salt_source: Column | None = None, small_key: str | None = None,
               big_key: str | None = None, fits: bool | None = None) -> DataFrame:
    """Join ``big`` with a side that is usually small (``fits``: what ``measure`` said of it, if it was asked before).

    * measured rows of ``small`` <= ``max_rows``: broadcast hash join, no
      shuffle of ``big`` at all (hot keys of ``big`` cost nothing extra).
    * otherwise: shuffle join. With ``salt_buckets`` > 1 the small side is
      replicated ``salt_buckets`` times and each big row picks one copy by
      ``salt_source``, so a key holding a third of ``big`` still splits over
      ``salt_buckets`` tasks. Salting needs an equi-join given as
      ``big_key``/``small_key`` column names. For a left join with
      ``big_key`` given, NULL keys bypass the shuffle.
    """
    if fits is None:
        small, fits = measure(small, max_rows)
    if fits:
        return big.join(F.broadcast(small), on, how)
    if how == "left" and big_key is not None:
        # Shuffle fallback: rows whose key is NULL can match nothing; keep them
        # out of the exchange (they would all hash to one partition — e.g. the
        # many products that hold no promotion) and add them back unmatched.
        nulls = big.filter(F.col(big_key).isNull())
        big = big.filter(F.col(big_key).isNotNull())
        joined = _shuffle_join(big, small, on, how, salt_buckets, salt_source, small_key, big_key)
        pad = nulls.select(*[F.col(c) for c in nulls.columns],
                           *[F.lit(None).cast(f.dataType).alias(f.name) for f in small.schema.fields
                             if f.name not in nulls.columns])
        return joined.unionByName(pad)
    return _shuffle_join(big, small, on, how, salt_buckets, salt_source, small_key, big_key)


def _shuffle_join(big, small, on, how, salt_buckets, salt_source, small_key, big_key):
    if salt_buckets and salt_buckets > 1 and big_key and small_key and how in ("left", "inner"):
        salt_col = "__salt"
        src = salt_source if salt_source is not None else F.monotonically_increasing_id()
        big_s = big.withColumn(salt_col, F.pmod(F.xxhash64(src), F.lit(salt_buckets)))
        small_s = small.withColumn(salt_col, F.explode(F.sequence(F.lit(0), F.lit(salt_buckets - 1))))
        cond = (big_s[big_key] == small_s[small_key]) & (big_s[salt_col] == small_s[salt_col])
        out = big_s.join(small_s, cond, how)
        return out.drop(big_s[salt_col]).drop(small_s[salt_col])
    return big.join(small, on, how)
