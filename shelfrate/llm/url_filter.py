"""URL filters by hashed host-suffix / path-prefix expressions.

Each URL is expanded into every (host suffix, path prefix) expression whose
lengths occur in the rule table, expressions meet the rules in an equi-join
on a short digest prefix, the full digest confirms, and the longest
confirmed rule decides.

Edge cases: a null URL or one without ``://`` has an empty host and path and
matches no rule; repeated rows are judged one by one and all returned; an
empty table gives an empty result; other columns of the input are ignored,
so clashing names do no harm. Two rules of one length that fit one URL
(only possible when the same rule is listed twice) resolve to ``block``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfrate.llm.common import lower_ascii

# Hex digits of the SHA-256 digest that the join key keeps.
PREFIX_HEX = 8
# Rules up to this number are broadcast (about 200 bytes a rule: 40 MB at most).
MAX_BROADCAST_RULES = 200_000


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def compile_rules(rules: DataFrame) -> DataFrame:
    """Rules (verdict, host, path) with their text and digest; rows with a null are no rules."""
    return (rules.dropna(subset=["verdict", "host", "path"])
            .select("verdict", "host", "path", F.concat("host", "path").alias("rule_text"))
            .groupBy("rule_text", "host", "path").agg(F.max("verdict").alias("rule_verdict"))
            .select("rule_text", "host", "path", "rule_verdict",
                    F.sha2(F.concat_ws("\n", "host", "path"), 256).alias("digest"))
            .withColumn("short", F.substring("digest", 1, PREFIX_HEX)))


def _expressions(host: Column, path: Column, host_lens: list[int], path_lens: list[int]) -> Column:
    """All (host suffix, path prefix) pairs whose lengths some rule has.

    A suffix counts if it is the whole host or starts after a dot.
    """
    n = F.length(host)
    suffixes = F.filter(
        F.array(*[F.when((n == k) | ((n > k) & (F.substring(host, F.greatest(n - k, F.lit(1)), F.lit(1)) == ".")),
                         F.substring(host, F.greatest(n - k + 1, F.lit(1)), F.lit(k))) for k in host_lens]),
        lambda s: s.isNotNull())
    prefixes = F.filter(
        F.array(*[F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in path_lens]),
        lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(
        prefixes, lambda p: F.sha2(F.concat_ws("\n", s, p), 256))))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow",
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict of every row: ``id_col``, host, path, rule, verdict, url.

    ``rules`` has (verdict, host, path). Distinct rule lengths bound the
    expansion, whatever the length of a URL. The rule table is broadcast up
    to ``MAX_BROADCAST_RULES`` rows (counted first), else shuffled.
    """
    compiled = compile_rules(rules)
    n_rules = compiled.count()
    row = F.monotonically_increasing_id()
    base = (pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
            .select(row.alias("_row"), "_id", "_url", url_host(F.col("_url")).alias("_host"),
                    url_path(F.col("_url")).alias("_path")))
    if n_rules == 0:
        return base.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"),
                           F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"),
                           F.col("_url").alias("url"))
    lens = compiled.agg(F.array_sort(F.collect_set(F.length("host"))).alias("h"),
                        F.array_sort(F.collect_set(F.length("path"))).alias("p")).head()
    keyed = compiled.select("short", "digest", "rule_text", "rule_verdict",
                            F.length("rule_text").alias("rule_len"))
    if n_rules <= MAX_BROADCAST_RULES:
        keyed = F.broadcast(keyed)
    expanded = base.select(
        "*", F.explode_outer(_expressions(F.col("_host"), F.col("_path"), lens.h, lens.p)).alias("_digest"))
    hits = expanded.join(keyed, F.substring("_digest", 1, PREFIX_HEX) == keyed["short"], "left")
    confirmed = F.col("_digest") == F.col("digest")
    best = F.max(F.when(confirmed, F.struct("rule_len", "rule_verdict", "rule_text")))
    return (hits.groupBy("_row", "_id", "_url", "_host", "_path").agg(best.alias("_best"))
            .select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"),
                    F.col("_best.rule_text").alias("rule"),
                    F.coalesce("_best.rule_verdict", F.lit(default)).alias("verdict"),
                    F.col("_url").alias("url")))
