"""Registered queries of the operators of this package, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrate.llm.common import prepare, table, values
from shelfrate.llm.decontaminate import decontaminate
from shelfrate.llm.divergence import oracle_sql as divergence_sql
from shelfrate.llm.divergence import source_divergence
from shelfrate.llm.html_extract import extract_main_text
from shelfrate.llm.mixing import mix
from shelfrate.llm.mixing import oracle_sql as mixing_sql
from shelfrate.llm.near_dup import near_duplicates
from shelfrate.llm.pii import find_pii
from shelfrate.llm.ppm import score_texts
from shelfrate.llm.quality_classifier import score_documents, train
from shelfrate.llm.quality_rules import compression_rules
from shelfrate.llm.ranked_search import oracle_sql as search_sql
from shelfrate.llm.ranked_search import ranked_search
from shelfrate.llm.substring_dedup import remove_repeats
from shelfrate.llm.suffix_dedup import remove_repeated_bytes
from shelfrate.llm.url_filter import judge_urls

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    """Register ``fn`` under its own name."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


# Verdict, host, path of the production rules.
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/"))


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL under the production rules."""
    rules = values(spark, list(URL_RULES), "verdict string, host string, path string")
    return judge_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE["op1_url_filter"] = """
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1')
      THEN 'block example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/')
      THEN 'block example.org/es/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'allow org/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'allow com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'block com/de/'
  END AS fit
  FROM parts)
SELECT page_id, host, path, split_part(fit, ' ', 2) AS rule,
       CASE WHEN fit IS NULL THEN 'allow' ELSE split_part(fit, ' ', 1) END AS verdict
FROM ruled
"""


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, compression ratios and verdict of every document."""
    return compression_rules(table(spark, sf_dir, "documents"))


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))


@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data spans of every document."""
    return find_pii(table(spark, sf_dir, "documents")).drop("span_list")


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words and items in every document."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hit_words", "items")


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token weight, probability and sampling decision of every document."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.coalesce("source", F.lit("")).alias("source"),
                        F.coalesce("lang", F.lit("")).alias("lang"), F.col("_topic").alias("topic"),
                        F.col("_tokens").alias("n_tokens"), F.round("_weight", 6).alias("weight"),
                        F.round("_prob", 6).alias("prob"), F.round("_miss", 6).alias("miss"),
                        F.col("_kept").alias("kept"))


ORACLE["op9_mixing"] = mixing_sql()


@query
def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document (three words, similarity 0.85)."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


@query
def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_main_text(table(spark, sf_dir, "pages"))


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat an earlier passage of 20 words or more."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans", "kept")


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that lie in a string of 200 bytes found elsewhere."""
    return remove_repeated_bytes(table(spark, sf_dir, "documents"), keep_first=False).drop("spans", "kept")


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and each source's telling terms."""
    return source_divergence(table(spark, sf_dir, "documents"))


ORACLE["op11_source_divergence"] = divergence_sql()


@query
def op12_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document under a byte-context model of the training documents."""
    return score_texts(table(spark, sf_dir, "documents"))


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op13_ranked_search"] = search_sql()
