"""Corpus pipeline: quality classifier, near-dedup, decontamination, PII, mixing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a frame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrate.llm.common import prepare, table, written
from shelfrate.llm.decontaminate import decontaminate
from shelfrate.llm.mixing import mix
from shelfrate.llm.near_dup import one_of_each
from shelfrate.llm.pii import redact_documents
from shelfrate.llm.quality_classifier import CUT, score_documents, train

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier, trained on the stage's own input, accepts.

    A null or empty text is scored like any other; repeated rows fare alike; without labels of both kinds the
    scores are all equal and reach the cut.
    """
    prepare(spark)
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model, carry=(*COLUMNS[2:], "text"))
    return scored.where(F.col("score") >= CUT).select(*COLUMNS)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document (the smallest id) of each group of near-duplicates: five words, similarity 0.8.

    Null ids, repeated ids and rows without words: see ``one_of_each``; an empty table stays empty.
    """
    prepare(spark)
    return one_of_each(docs.select(*COLUMNS), size=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop every document that holds a window of a benchmark item; texts without words and an empty table pass."""
    prepare(spark)
    judged = decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=COLUMNS)
    return judged.where(~F.col("contaminated")).select(*COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every personal data span by its kind; ``n_chars`` follows the new text (a null text is empty)."""
    prepare(spark)
    return redact_documents(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample the documents to the raked source, language and topic weights; null sources and languages are ''."""
    prepare(spark)
    return (mix(docs).where("_kept").select(*COLUMNS, F.col("_topic").alias("topic"), F.round("_prob", 6).alias("prob")))


STAGES = [("quality_classifier", quality_classifier), ("near_dup", near_dup),
          ("benchmark_decontamination", benchmark_decontamination), ("pii", pii), ("mixing", mixing)]

# Training, the forest and the trees have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
