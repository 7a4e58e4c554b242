import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfrate.llm.common import values
from shelfrate.llm.mixing import calibrate, mix, rake


def frame(spark, n=3000, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.choices(["hot", "b", "c", None], [6, 2, 1, 1])[0]
        rows.append((i, "x" * rng.randrange(0, 6000), rng.choice(["en", "de", None]), s, 0, "clash"))
    rows += [(None, "abc", "en", "b", 3, "clash"), (1, rows[1][1], rows[1][2], rows[1][3], 0, "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, weight string")


def numpy_rake(table, goals, sweeps):
    w = np.ones_like(table)
    for _ in range(sweeps):
        for axis, goal in enumerate(goals):
            others = tuple(a for a in range(3) if a != axis)
            factor = np.array(goal) * table.sum() / (table * w).sum(axis=others)
            w = w * factor.reshape([-1 if a == axis else 1 for a in range(3)])
    return w


def test_raking_matches_numpy_and_meets_the_margins(spark):
    rng = np.random.default_rng(3)
    table = rng.integers(1, 1000, (3, 2, 4)).astype(float)
    cells = values(spark, [(f"s{i}", f"l{j}", f"t{k}", int(table[i, j, k])) for i in range(3) for j in range(2) for k in range(4)],
                   "source string, lang string, topic string, tokens long")
    goals = {"source": [0.2, 0.3, 0.5], "lang": [0.6, 0.4], "topic": [0.1, 0.2, 0.3, 0.4]}
    targets = {d: values(spark, [(f"{d[0]}{i}", v) for i, v in enumerate(g)] + [("absent", 0.7)], f"{d} string, share double")
               for d, g in goals.items()}
    got = {(r.source, r.lang, r.topic): r.weight for r in rake(cells, targets, 6).collect()}
    want = numpy_rake(table, list(goals.values()), 6)
    for (s, l, t), w in got.items():
        assert w == pytest.approx(want[int(s[1]), int(l[1]), int(t[1])])


def test_calibration_meets_the_budget(spark):
    cells = values(spark, [("a", "l", "t", 100, 8.0), ("b", "l", "t", 900, 1.0)],
                   "source string, lang string, topic string, tokens long, weight double")
    got = {r.source: r.prob for r in calibrate(cells, 0.5).collect()}
    assert got["a"] == 1.0 and 100 * got["a"] + 900 * got["b"] == pytest.approx(500)


def test_mix_keeps_rows_columns_and_shares(spark):
    docs = frame(spark)
    mixed = mix(docs).cache()
    assert mixed.count() == docs.count() and mixed.where("weight = 'clash'").count() == docs.count()
    total = mixed.agg(F.sum("_tokens")).head()[0]
    kept = mixed.where("_kept").agg(F.sum("_tokens")).head()[0]
    assert kept / total == pytest.approx(0.75, abs=0.03)
    hot = F.when(F.col("source") == "hot", F.col("_tokens")).otherwise(0)
    before = docs.join(mixed.select("doc_id", "_tokens"), "doc_id").agg(F.sum(hot) / F.sum("_tokens")).head()[0]
    after = mixed.where("_kept").agg(F.sum(hot) / F.sum("_tokens")).head()[0]
    assert after < before
    again = {r.doc_id: r._kept for r in mix(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r._kept for r in mixed.collect()}
    assert mix(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.range(5).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), F.lit("s").alias("source"),
                                 F.lit("l").alias("lang"))
    assert "Python" not in mix(docs)._jdf.queryExecution().executedPlan().toString()


def spread(spark, table):
    """Documents whose tokens by (source, lang) are ``table``: texts of 400 code points, 100 tokens each."""
    rows, at = [], 0
    for (s, lang), n in table.items():
        for _ in range(n):
            rows.append((at, "x" * 400, lang, s))
            at += 1
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def shares(mixed, dim):
    got = mixed.groupBy(dim).agg(F.sum(F.col("_tokens") * F.col("_prob")).alias("v")).collect()
    whole = sum(r.v for r in got)
    return {r[dim]: r.v / whole for r in got}, whole


def test_attainable_targets_are_met_though_probabilities_are_cut(spark):
    docs = spread(spark, {("hot", "en"): 500, ("hot", "de"): 100, ("cold", "en"): 100, ("cold", "de"): 300})
    targets = {"source": values(spark, [("hot", 0.5), ("cold", 0.5)], "source string, share double"),
               "lang": values(spark, [("en", 0.5), ("de", 0.5)], "lang string, share double")}
    mixed = mix(docs, targets=targets, budget=0.78).cache()
    assert mixed.agg(F.max("_prob")).head()[0] == pytest.approx(1.0, abs=1e-4)
    for dim in ("source", "lang"):
        got, whole = shares(mixed, dim)
        assert all(v == pytest.approx(0.5, abs=1e-3) for v in got.values()), got
        assert whole == pytest.approx(0.78 * 100_000, rel=1e-3)
    assert mixed.agg(F.max("_miss")).head()[0] < 1e-3


def test_a_target_beyond_the_tokens_takes_all_and_says_so(spark):
    docs = spread(spark, {("hot", "en"): 900, ("cold", "en"): 100})
    targets = {"source": values(spark, [("hot", 0.5), ("cold", 0.5)], "source string, share double")}
    mixed = mix(docs, targets=targets, budget=0.5).cache()
    probs = {r.source: r._prob for r in mixed.select("source", "_prob").distinct().collect()}
    assert probs["cold"] == 1.0 and probs["hot"] == pytest.approx(400 / 900)
    assert mixed.select("_miss").distinct().head()[0] == pytest.approx(0.3)


def test_many_cells_are_raked_alike_by_joins(spark, monkeypatch):
    docs = frame(spark, 300)
    want = {r.doc_id: (r._prob, r._miss) for r in mix(docs).select("doc_id", "_prob", "_miss").collect()}
    monkeypatch.setattr("shelfrate.llm.mixing.MAX_BROADCAST_CELLS", 0)
    got = {r.doc_id: (r._prob, r._miss) for r in mix(docs).select("doc_id", "_prob", "_miss").collect()}
    assert got.keys() == want.keys()
    for k, v in got.items():
        assert v == pytest.approx(want[k], abs=1e-9)
