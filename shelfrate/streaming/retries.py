"""Per-message retries and dead letters of a message stream.

Each micro-batch handles its new messages together with those that failed in
the micro-batch before. A body that is not JSON is a dead letter at once; a
message whose processing fails is tried again alone in the next micro-batch,
and is a dead letter after ``max_attempts`` attempts. The others of its batch
are not held up.

The only state is a log of outcomes, one folder for each micro-batch. A
micro-batch reads folders of earlier micro-batches only and overwrites its
own, so one that is run again after a failure writes the same rows. A message
id that an earlier micro-batch has seen is a repeated delivery and is ignored.

Edge cases: of repeated ids within a micro-batch one is handled, the one with
the smallest body; a null body is malformed; messages without an id are
dropped, as nothing could tell their deliveries apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrate.sources.messages import split_messages

MAX_ATTEMPTS = 3
OK, RETRY, DEAD = "OK", "RETRY", "DEAD_LETTER"
_LOG = "message_id string, body string, attempts int, outcome string, reason string, batch long"

# (message_id, message, attempts) -> (message_id, error); error is null for a message that is done.
Process = Callable[[DataFrame], DataFrame]


class MessageLog:
    """Outcomes of messages, one folder for each micro-batch below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        root.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(root)

    def rows(self) -> DataFrame:
        """All outcomes."""
        return self.spark.read.schema(_LOG).parquet(self.path)

    def before(self, batch: int) -> DataFrame:
        """Outcomes of earlier micro-batches."""
        return self.rows().where(F.col("batch") < batch)

    def write(self, outcomes: DataFrame, batch: int) -> None:
        """The outcomes of one micro-batch, in place of what an earlier run of it wrote."""
        outcomes.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def last(self) -> int:
        """Number of the last micro-batch with outcomes, -1 without any."""
        at = self.rows().agg(F.max("batch")).head()[0]
        return -1 if at is None else at


def handle_batch(log: MessageLog, messages: DataFrame, batch: int, process: Process,
                 max_attempts: int = MAX_ATTEMPTS) -> None:
    """Handle the new ``messages`` (message_id, body) and the pending ones of the micro-batch before."""
    earlier = log.before(batch)
    new = (messages.select(F.col("message_id").cast("string"), F.col("body").cast("string"))
           .where("message_id IS NOT NULL").groupBy("message_id").agg(F.min("body").alias("body"))
           .join(earlier.select("message_id"), "message_id", "left_anti").withColumn("attempts", F.lit(1)))
    pending = (earlier.where((F.col("batch") == batch - 1) & (F.col("outcome") == RETRY))
               .select("message_id", "body", (F.col("attempts") + 1).alias("attempts")))
    good, dead = split_messages(new.unionByName(pending), "body")
    errors = process(good.select("message_id", "message", "attempts")).select("message_id", F.col("error").alias("reason"))
    outcome = (F.when(F.col("reason").isNull(), OK).when(F.col("attempts") < max_attempts, RETRY).otherwise(DEAD))
    columns = ["message_id", "body", "attempts", "outcome", "reason"]
    handled = good.join(errors, "message_id", "left").withColumn("outcome", outcome).select(*columns)
    log.write(handled.unionByName(dead.withColumn("outcome", F.lit(DEAD)).select(*columns)), batch)


def start_message_stream(messages: DataFrame, log: MessageLog, process: Process, checkpoint: str,
                         max_attempts: int = MAX_ATTEMPTS, available_now: bool = True):
    """Handle a stream of (message_id, body) into ``log``."""
    def handle(df: DataFrame, batch: int) -> None:
        handle_batch(log, df, batch, process, max_attempts)

    writer = messages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def drain(log: MessageLog, process: Process, max_attempts: int = MAX_ATTEMPTS) -> None:
    """Retry what is pending after the last micro-batch, until every message is done or a dead letter.

    For a stream that is over: its number of micro-batches goes on from the log.
    """
    none = log.spark.createDataFrame([], "message_id string, body string")
    for _ in range(max_attempts):
        at = log.last()
        if log.rows().where((F.col("batch") == at) & (F.col("outcome") == RETRY)).isEmpty():
            return
        handle_batch(log, none, at + 1, process, max_attempts)


def final_outcomes(log: MessageLog) -> DataFrame:
    """(message_id, body, attempts, outcome, reason): what became of each message; RETRY if it is pending."""
    last = F.struct("attempts", "body", "outcome", "reason")
    return log.rows().groupBy("message_id").agg(F.max(last).alias("x")).select(
        "message_id", "x.body", "x.attempts", "x.outcome", "x.reason")
