"""Admission of dense targets in rounds, against one request at a time."""

import datetime as dt
import random

import pytest
from admission_reference import admit_reference
from pyspark.sql import functions as F

from shelfrate.operators import admission

BASE = dt.datetime(2026, 1, 1)
SCHEMA = ("id string, scope string, target_product_id string, target_category_id string, starts_at timestamp, "
          "ends_at timestamp, created_at timestamp, arrival long, status string")


def _requests(rnd, n, order):
    rows = []
    for i in range(n):
        s = BASE + dt.timedelta(minutes=rnd.randint(0, 40 * n))
        e = s + dt.timedelta(minutes=rnd.choice([30, 200, 2000]))
        arrival = {"random": rnd.randrange(n // 2), "in time": int((s - BASE).total_seconds()), "same": 7}[order]
        rows.append((f"r{i:05}", "PRODUCT", rnd.choice(["hot", "hot", "hot", "p2"]), None, s, e,
                     BASE + dt.timedelta(seconds=arrival), arrival, "SCHEDULED"))
    return rows


def _fields(rows):
    return [dict(zip([c.split()[0] for c in SCHEMA.split(", ")], r, strict=True)) for r in rows]


@pytest.mark.parametrize("order", ["random", "in time", "same"])
def test_rounds_equal_the_fold(spark, monkeypatch, order):
    monkeypatch.setattr(admission, "ROUNDS_MIN", 20)
    monkeypatch.setattr(admission, "CATALYST_FOLD_MAX", 3)
    rows = _requests(random.Random(17), 150, order)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    prods = spark.createDataFrame([("hot", "c1"), ("p2", "c1")], "id string, category_id string")
    got = admission.admit(df, df.limit(0), prods).collect()
    assert {r.id: r.admitted for r in got} == admit_reference(_fields(rows), [], {"hot": "c1", "p2": "c1"})
    assert all((r.reason is None) == r.admitted for r in got)


def test_random_arrivals_need_few_rounds(spark):
    rows = _requests(random.Random(5), 4000, "random")
    df = spark.createDataFrame(rows, SCHEMA)
    decided, rest = admission.decide_in_rounds(df, "target_product_id")
    got = decided.collect()
    assert len(got) == len({r.id for r in got}) and len(got) + rest.count() == 4000
    want = admit_reference(_fields(rows), [], {})
    assert all(r.ok == want[r.id] for r in got)
    assert max(r.round for r in got) <= 10 and rest.count() < 200


def test_no_requests(spark):
    decided, rest = admission.decide_in_rounds(spark.createDataFrame([], SCHEMA), "target_product_id")
    assert decided.columns == ["id", "ok", "round"] and decided.count() == 0 and rest.count() == 0
    assert admission._fold_by_key(spark.createDataFrame([], SCHEMA).withColumn("x", F.lit(1)), "target_product_id").count() == 0
