"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells (source, language, topic) of tokens. A
category cannot give more tokens than it has: of a budget, what a category
asks beyond its tokens is spread over the others by their shares, which gives
its attainable target. Raking then multiplies the cell weights by one factor
for each source, language and topic in turn, until the expected tokens
sum(tokens * min(1, weight)) meet the attainable targets within ``TOLERANCE``
of the whole, or ``SWEEPS`` sweeps are done (margins that contradict each
other cannot be met together). The probability of a cell is min(1, weight),
so the cut at one is part of the fit and does not disturb the margins after
it. Every row carries ``_miss``: by how much the expected token share of its
source, language or topic (the largest of the three) misses the asked share.
The draw is a hash of seed and id, so it does not depend on the partitioning
and can be repeated.

Only DataFrame functions run. The cell table is an aggregate: it is written
once and stays small beside the corpus; the driver sees single numbers.

Edge cases: a null source or language is a category of its own (the empty
name); a null or empty text has no tokens and is kept with the probability
of its cell; categories without a target or without tokens get weight zero,
targets without documents are spread over the others; repeated ids share one
draw, so repeated rows are kept or dropped together; a null id draws like the
empty name; an empty table gives an empty result; other columns stay untouched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfrate.llm.common import drop_written, written

DIMS = ("source", "lang", "topic")
SWEEPS = 30
# Sweeps between two written tables and tests of the margins.
ROUND = 5
# Sweeps end when every category is this near its attainable target, as a share of the budget.
TOLERANCE = 1e-6
BUDGET = 0.75
# Weight of cells that are taken whole, and bound of all weights.
WHOLE = 1e50
ALPHA = 0.7
SEED = "mix-1"
CHARS_PER_TOKEN = 4
# Cells up to this number are broadcast to the documents (about 100 bytes a cell) and raked by one task, with windows
# over a category; beyond it all tasks rake, with sums joined back, so that a category may hold any number of cells.
MAX_BROADCAST_CELLS = 200_000


def token_count(text: Column) -> Column:
    """Tokens of a text, estimated as one per four code points, rounded up."""
    return F.coalesce(F.ceil(F.length(text) / CHARS_PER_TOKEN), F.lit(0)).cast("long")


def form_topic(text: Column) -> Column:
    """Topic by form, for corpora without a topic field: table, brief, note, article or long read."""
    n = F.coalesce(F.length(text), F.lit(0))
    pipes = n - F.coalesce(F.length(F.replace(text, F.lit("|"), F.lit(""))), F.lit(0))
    return (F.when(pipes * 50 > n, "table").when(n < 400, "brief").when(n < 2000, "note")
            .when(n < 10000, "article").otherwise("long"))


def draw(id_col: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the digest of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(2**52)


def tempered_targets(cells: DataFrame, dim: str, alpha: float = ALPHA) -> DataFrame:
    """Target shares (dim, share) proportional to tokens to the power ``alpha``."""
    sums = cells.groupBy(dim).agg(F.pow(F.sum("tokens"), F.lit(alpha)).alias("p"))
    total = sums.agg(F.sum("p")).head()[0] or 1.0
    return sums.select(dim, (F.col("p") / F.lit(total)).alias("share"))


def present_targets(cells: DataFrame, dim: str, targets: DataFrame) -> DataFrame:
    """(dim, share, tokens): the targets of the categories that have documents, their shares summing to one."""
    kept = cells.groupBy(dim).agg(F.sum("tokens").alias("tokens")).join(targets, dim)
    whole = kept.agg(F.sum("share")).head()[0] or 1.0
    return written(kept.select(dim, (F.col("share") / F.lit(whole)).alias("share"), "tokens"), f"target-{dim}")


def attainable(present: DataFrame, dim: str, budget: float) -> DataFrame:
    """(dim, goal, whole): tokens that a category can give of its share of the budget; whole if these are all it has."""
    weights = present.withColumn("weight", F.when(F.col("tokens") > 0, F.col("share") / F.col("tokens")).otherwise(0.0))
    return calibrate(weights, budget).select(dim, (F.col("tokens") * F.col("prob")).alias("goal"),
                                             (F.col("prob") >= 1).alias("whole"))


def _stepped(cells: DataFrame, dim: str, given: Column, few: bool) -> DataFrame:
    """``cells`` with weights multiplied so that ``given`` moves to the goal of each category of one dimension."""
    have = F.sum(F.col("tokens") * given)
    if few:
        summed = cells.withColumn("_have", have.over(Window.partitionBy(dim)))
    else:
        summed = cells.join(cells.groupBy(dim).agg(have.alias("_have")), dim)
    factor = F.when(F.col("_have") > 0, F.col(f"_goal_{dim}") / F.col("_have")).otherwise(0.0)
    return summed.select(*[F.least(F.col("weight") * factor, F.lit(WHOLE)).alias(c) if c == "weight" else c
                           for c in cells.columns])


def _category_sums(cells: DataFrame, value: Column) -> DataFrame:
    """(dim, name, have): sums of ``value`` over the categories of every dimension."""
    return (cells.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("name")) for d in DIMS])).alias("c"),
                         value.alias("v")).groupBy("c.dim", "c.name").agg(F.sum("v").alias("have")))


def _by_name(frames: dict[str, DataFrame], *columns: str) -> DataFrame:
    """The frames of the dimensions as one, (dim, name, *columns)."""
    out = None
    for dim, f in frames.items():
        part = f.select(F.lit(dim).alias("dim"), F.col(dim).alias("name"), *columns)
        out = part if out is None else out.unionByName(part)
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS, budget: float | None = None,
         tolerance: float = 0.0) -> DataFrame:
    """Cells with ``weight``, raked for up to ``sweeps`` sweeps to the target shares (dim, share).

    Without a ``budget`` weights are free and weighted tokens sum to all tokens. With one, weights above one
    count as one and the expected tokens meet the attainable targets. ``tolerance`` (a share of the budget) ends
    the sweeps early.
    """
    total = float(cells.agg(F.sum("tokens")).head()[0] or 0.0)
    given = F.col("weight") if budget is None else F.least(F.col("weight"), F.lit(1.0))
    few = cells.count() <= MAX_BROADCAST_CELLS
    out, weight = cells, F.lit(1.0 if budget is None else float(budget))
    for dim, t in targets.items():
        present = present_targets(cells, dim, t)
        if budget is None:
            goal = present.select(dim, (F.col("share") * F.lit(total)).alias("goal"), F.lit(False).alias("whole"))
        else:
            goal = written(attainable(present, dim, budget), f"goal-{dim}")
        out = (out.join(goal, dim, "left").withColumn(f"_goal_{dim}", F.coalesce("goal", F.lit(0.0)))
               .withColumn(f"_whole_{dim}", F.coalesce("whole", F.lit(False))).drop("goal", "whole"))
        weight = F.when(F.col(f"_whole_{dim}"), F.lit(WHOLE)).otherwise(weight)
    out = written(out.withColumn("weight", weight).drop(*[f"_whole_{d}" for d in targets]), "raked")
    every = ROUND if few else 1
    for done in range(0, sweeps, every):
        nxt = out.coalesce(1) if few else out  # few cells need no shuffle for each dimension
        for dim in list(targets) * min(every, sweeps - done):
            nxt = _stepped(nxt, dim, given, few)
        last, out = out, written(nxt, "raked")  # each round reads the last one: plans stay small
        drop_written(last)
        gaps = [out.groupBy(d).agg(F.abs(F.sum(F.col("tokens") * given) - F.first(f"_goal_{d}")).alias("gap")).select("gap")
                for d in targets]
        gap = reduce(DataFrame.unionAll, gaps).agg(F.max("gap")).head()[0]
        if (done + every) % ROUND == 0 and (gap is None or gap <= tolerance * total * (budget or 1.0)):
            break
    return out.drop(*[f"_goal_{d}" for d in targets])


def calibrate(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Rows with ``prob`` = min(1, scale * weight), expected tokens = budget share of all tokens.

    Rows that reach one leave the others more; rounds end when no further row reaches one.
    """
    total = float(cells.agg(F.sum("tokens")).head()[0] or 0.0)
    scale, n_full = 0.0, -1
    while True:
        capped = F.col("weight") * F.lit(scale) >= 1
        r = cells.agg(F.sum(F.when(capped, F.col("tokens")).otherwise(0)).alias("full"),
                      F.sum(F.when(~capped, F.col("tokens") * F.col("weight")).otherwise(0.0)).alias("open"),
                      F.count(F.when(capped, 1)).alias("n")).head()
        if not r.open or r.n <= n_full:
            break
        scale, n_full = (budget * total - float(r.full)) / float(r.open), r.n
    return cells.withColumn("prob", F.least(F.lit(1.0), F.col("weight") * F.lit(scale)))


def margins(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """(dim, name, asked, expected): asked and expected token shares of every category of cells with ``prob``."""
    expected = float(cells.agg(F.sum(F.col("tokens") * F.col("prob"))).head()[0] or 0.0) or 1.0
    asked = _by_name({d: present_targets(cells, d, t) for d, t in targets.items()}, "share")
    return (_category_sums(cells, F.col("tokens") * F.col("prob")).join(asked, ["dim", "name"], "left")
            .select("dim", "name", F.coalesce("share", F.lit(0.0)).alias("asked"),
                    (F.col("have") / F.lit(expected)).alias("expected")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None,
        targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, seed: str = SEED) -> DataFrame:
    """``docs`` with _topic, _tokens, _weight, _prob, _miss and _kept beside its own columns.

    ``_weight`` is the probability over the budget. ``targets`` maps source, lang and topic to frames (dimension, share);
    a dimension without one gets tempered shares of its own tokens.
    """
    text = F.col(text_col).cast("string")
    keyed = docs.withColumns({
        "_s": F.coalesce(F.col("source").cast("string"), F.lit("")),
        "_l": F.coalesce(F.col("lang").cast("string"), F.lit("")),
        "_topic": F.coalesce(form_topic(text) if topic is None else topic, F.lit("")), "_tokens": token_count(text)})
    cells = written(keyed.groupBy(F.col("_s").alias("source"), F.col("_l").alias("lang"), F.col("_topic").alias("topic"))
                    .agg(F.sum("_tokens").alias("tokens")), "cells")
    goal = {d: (targets or {}).get(d) for d in DIMS}
    goal = {d: t if t is not None else tempered_targets(cells, d) for d, t in goal.items()}
    raked = rake(cells, goal, budget=budget, tolerance=TOLERANCE)
    fitted = raked.withColumn("prob", F.least(F.lit(1.0), "weight"))
    missed = written(margins(fitted, goal).withColumn("miss", F.abs(F.col("asked") - F.col("expected"))), "margins")
    for d in DIMS:
        fitted = fitted.join(missed.where(F.col("dim") == d).select(F.col("name").alias(d), F.col("miss").alias(f"_m_{d}")), d)
    probs = written(fitted.select(
        F.col("source").alias("_s"), F.col("lang").alias("_l"), F.col("topic").alias("_topic"),
        (F.col("prob") / F.lit(budget)).alias("_weight"), F.col("prob").alias("_prob"),
        F.greatest(*[f"_m_{d}" for d in DIMS]).alias("_miss")), "probabilities")
    if probs.count() <= MAX_BROADCAST_CELLS:
        probs = F.broadcast(probs)
    return (keyed.join(probs, ["_s", "_l", "_topic"])
            .withColumn("_kept", draw(F.col(id_col), seed) < F.col("_prob")).drop("_s", "_l"))


def oracle_sql(sweeps: int = SWEEPS, budget: float = BUDGET, alpha: float = ALPHA, tolerance: float = TOLERANCE,
               seed: str = SEED) -> str:
    """The same computation as DuckDB SQL: attainable targets by running sums, the sweeps as a recursive table."""
    steps = ["""keyed AS (SELECT doc_id, coalesce(source, '') AS s, coalesce(lang, '') AS l,
  coalesce(ceil(length(text) / 4.0), 0)::BIGINT AS tok,
  CASE WHEN (length(coalesce(text, '')) - length(replace(coalesce(text, ''), '|', ''))) * 50 > length(coalesce(text, ''))
    THEN 'table' WHEN length(coalesce(text, '')) < 400 THEN 'brief' WHEN length(coalesce(text, '')) < 2000 THEN 'note'
    WHEN length(coalesce(text, '')) < 10000 THEN 'article' ELSE 'long' END AS t FROM documents)""",
             "cells AS (SELECT s, l, t, sum(tok)::DOUBLE AS tokens FROM keyed GROUP BY s, l, t)",
             "total AS (SELECT sum(tokens) AS n FROM cells)"]
    for d in "slt":
        steps.append(f"""asked_{d} AS (SELECT {d}, tok, p / sum(p) OVER () AS share
  FROM (SELECT {d}, sum(tokens) AS tok, pow(sum(tokens), {alpha}) AS p FROM cells GROUP BY {d}))""")
        steps.append(f"""line_{d} AS (SELECT *, row_number() OVER o AS pos,
    ({budget} * n - coalesce(sum(tok) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (1 - coalesce(sum(share) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS z
  FROM asked_{d}, total WINDOW o AS (ORDER BY share / nullif(tok, 0) DESC NULLS LAST, {d}))""")
        steps.append(f"""goal_{d} AS MATERIALIZED (SELECT {d}, share, least(tok, share * (SELECT arg_min(z, pos) FROM line_{d}
    WHERE share * z < tok)) AS goal, share * (SELECT arg_min(z, pos) FROM line_{d} WHERE share * z < tok) >= tok
    AND tok > 0 AS whole FROM line_{d})""")
    have = {d: f"sum(tokens * least(1.0, weight)) OVER (PARTITION BY {d})" for d in "slt"}
    steps.append(f"""based AS MATERIALIZED (SELECT c.*, a.goal AS gs, b.goal AS gl, e.goal AS gt, a.share AS ss, b.share AS sl,
    e.share AS st, CASE WHEN a.whole OR b.whole OR e.whole THEN {WHOLE} ELSE {budget} END AS start
  FROM cells c JOIN goal_s a USING (s) JOIN goal_l b USING (l) JOIN goal_t e USING (t))""")
    steps.append(f"""raked(k, s, l, t, tokens, gs, gl, gt, ss, sl, st, weight) AS (
  SELECT 0, s, l, t, tokens, gs, gl, gt, ss, sl, st, start::DOUBLE FROM based
  UNION ALL
  SELECT k + 1, s, l, t, tokens, gs, gl, gt, ss, sl, st, least({WHOLE}, weight * CASE k % 3
      WHEN 0 THEN (CASE WHEN hs > 0 THEN gs / hs ELSE 0 END) WHEN 1 THEN (CASE WHEN hl > 0 THEN gl / hl ELSE 0 END)
      ELSE (CASE WHEN ht > 0 THEN gt / ht ELSE 0 END) END)
  FROM (SELECT *, max(greatest(abs(hs - gs), abs(hl - gl), abs(ht - gt))) OVER () AS gap
        FROM (SELECT *, {have["s"]} AS hs, {have["l"]} AS hl, {have["t"]} AS ht FROM raked)), total
  WHERE k < {3 * sweeps} AND NOT (k > 0 AND k % {3 * ROUND} = 0 AND gap <= {tolerance} * n * {budget}))""")
    steps.append(f"""fitted AS MATERIALIZED (SELECT s, l, t, prob, greatest(abs(ss - hs / whole), abs(sl - hl / whole),
    abs(st - ht / whole)) AS miss
  FROM (SELECT *, least(1.0, weight) AS prob, {have["s"]} AS hs, {have["l"]} AS hl, {have["t"]} AS ht,
          sum(tokens * least(1.0, weight)) OVER () AS whole
        FROM raked WHERE k = (SELECT max(k) FROM raked)))""")
    return "WITH RECURSIVE " + ",\n".join(steps) + f"""
SELECT doc_id, s AS source, l AS lang, t AS topic, tok AS n_tokens, round(prob / {budget}, 6) AS weight,
  round(prob, 6) AS prob, round(miss, 6) AS miss,
  ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 < prob AS kept
FROM keyed JOIN fitted USING (s, l, t)"""
