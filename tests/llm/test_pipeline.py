"""corpus_pipeline: each stage on its predecessor's output against brute force, edge cases, registration."""

import os
import random
import re
import sys

import pytest
from helpers import DOC_SCHEMA, prose

import __spark_entry__ as entry
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402
from test_decontaminate import brute as brute_hits  # noqa: E402
from test_near_dup import brute as brute_groups  # noqa: E402
from test_pii import KINDS, brute as brute_spans  # noqa: E402

from shelfrate.llm.mixing import draw, mix  # noqa: E402
from shelfrate.llm.quality_classifier import CUT, score_documents, train  # noqa: E402

COLUMNS = [c.split(" ")[0] for c in DOC_SCHEMA.split(", ")]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """A folder with small documents, labels and benchmark tables."""
    rng = random.Random(21)
    items = [(i, prose(rng, 30, 10**5)) for i in range(5)]
    rows, labels, good = [], [], []
    for i in range(240):
        text = prose(rng, rng.randrange(40, 120), 10**5)
        bad = i % 6 == 0
        if bad:
            text = " ".join(w + rng.choice(["!!", "###", " |", "$$$"]) for w in text.split())
        elif i % 20 == 1:
            text = good[-1] if good else text
        elif i % 20 == 3:
            w = good[-1].split()
            w[len(w) // 2] = "changed"
            text = " ".join(w)
        elif i % 20 == 5:
            text += " " + items[i % 5][1]
        elif i % 20 == 7:
            text += f" mail user{i}@mail.example.com or +1 (555) 010-{1000 + i} from 10.0.0.{i} card 4111111111111111"
        if not bad:
            good.append(text)
        rows.append((i, text, rng.choice(["en", "de", None]), f"src{rng.randrange(4)}", len(text)))
        if i % 4:
            labels.append((i, 0 if bad else 1, 0))
    rows += [(300, None, "en", "src0", 0), (301, "", "en", "src0", 0), (302, "w" * 50000, None, None, 50000), rows[10], rows[10],
             (None, "no id here at all", "en", "src1", 17)]
    folder = str(tmp_path_factory.mktemp("sf"))
    for name, data, schema in (("documents", rows, DOC_SCHEMA), ("labels", labels, "doc_id long, quality int, toxic int"),
                               ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return folder, rows, items


def as_map(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_against_brute_force(spark, data, tmp_path):
    folder, _, items = data
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    outs = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "mixing" or docs.columns == COLUMNS
        outs[name] = (before, docs)

    before, after = outs["quality_classifier"]
    scores = score_documents(before, train(before, spark.read.parquet(f"{folder}/labels.parquet"))).collect()
    keep = sorted(str(r.doc_id) for r in scores if r.score >= CUT)
    assert sorted(str(r.doc_id) for r in after.collect()) == keep
    assert {i for i in as_map(before) if i is not None and i < 240 and i % 6} <= set(as_map(after))
    assert not {i for i in range(0, 240, 6)} & set(as_map(after))

    before, after = outs["near_dup"]
    texts = {i: r.text for i, r in as_map(before).items() if i is not None}
    groups = brute_groups(list(texts.items()), 5, 80)
    assert {i for i in as_map(after) if i is not None} == {i for i, (_, root) in groups.items() if i == root}
    assert after.where("doc_id = 10").count() <= 1

    before, after = outs["benchmark_decontamination"]
    clean = {i for i, r in as_map(before).items() if not brute_hits(r.text, items)[4]}
    assert set(as_map(after)) == clean and len(clean) < before.count()

    before, after = outs["pii"]
    assert set(as_map(before)) == set(as_map(after))
    changed = 0
    for i, r in as_map(before).items():
        want = r.text
        spans = sorted((int(s.split(":")[1]), int(s.split(":")[2]), k) for k in KINDS for s in brute_spans(r.text)[k])
        for a, z, k in reversed(spans):
            want = want[:a] + f"<{k.upper()}>" + want[z:]
        got = as_map(after)[i]
        assert got.text == want and got.n_chars == len(want or "") if spans else got.text == r.text
        changed += bool(spans)
    assert changed > 3

    before, after = outs["mixing"]
    mixed = mix(before).withColumn("_drawn", draw(F.col("doc_id"))).collect()
    picked = {r.doc_id for r in mixed if r["_drawn"] < r["_prob"]}
    assert {r.doc_id for r in after.collect()} == picked
    assert set(after.columns) >= set(COLUMNS) and 0 < after.count() < before.count()


def test_run_equals_the_stages_and_is_registered(spark, data):
    folder, _, _ = data
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "near_dup", "benchmark_decontamination", "pii", "mixing"]
    a = sorted(str(tuple(r)) for r in corpus_pipeline.run(spark, folder).collect())
    b = sorted(str(tuple(r)) for r in entry.queries()["pipeline"](spark, folder).collect())
    assert a == b and a


def test_stages_on_empty_input_and_extra_columns(spark, data):
    folder, _, _ = data
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), folder)
        assert out.count() == 0, name
        wide = docs.where("doc_id < 40").selectExpr(
            "*", "1 as score", "'x' as _text", "2 as node", "'y' as _topic0", "true as kept", "0 as n_words", "'z' as spans")
        assert stage(spark, wide, folder).columns[:5] == COLUMNS, name


def test_every_dealt_operator_is_registered_once():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert {"op1_url_filter", "op9_mixing", "op11_source_divergence", "op13_ranked_search"} <= set(entry.oracle_sql())
