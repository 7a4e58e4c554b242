"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrate.session import ensure_checkpoint_dir, ship_package

# Rows per Arrow batch handed to Python: texts can be long, so batches are small.
ARROW_ROWS = 256


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder, package on the executors, small Arrow batches."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder and read back.

    Cuts the lineage: a lost executor costs at most the work since the last
    written table, and later branches do not compute ``df`` again. ``codec``
    names a compression other than the session's.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a frame that ``written`` returned; it must not be read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small literal table built by the JVM only (no Python rows to ship)."""
    names = [c.strip().split(" ") for c in schema.split(",")]
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in names])
    structs = [F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, names, strict=True)]) for r in rows]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*structs)))


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
