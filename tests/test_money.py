"""Golden rows of the price, rounding and feed pricing rules."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfrate.functions import money as M

D = Decimal


def _price(spark, rows):
    df = spark.createDataFrame(rows, "base decimal(18,6), t string, v decimal(18,6)")
    return [r[0] for r in df.select(M.effective_price("base", "t", "v")).collect()]


def test_no_promotion(spark):
    got = _price(spark, [(D("100"), None, None), (D("99.999"), None, None), (D("99.994"), None, None),
                         (D("50"), None, None)])
    assert got == [D("100.00"), D("100.00"), D("99.99"), D("50.00")]


def test_percentage(spark):
    cases = [("100", "25", "75"), ("100", "0.5", "99.5"), ("200", "50", "100"), ("19.99", "10", "17.99"),
             ("100", "100", "0"), ("100", "150", "0"), ("100", "33.335", "66.67"), ("100", "33.334", "66.67"),
             ("1.99", "10", "1.79")]
    got = _price(spark, [(D(b), "PERCENTAGE", D(v)) for b, v, _ in cases])
    assert got == [D(e).quantize(D("0.01")) for _, _, e in cases]


def test_fixed(spark):
    cases = [("100", "10", "90"), ("100", "99.99", "0.01"), ("100", "100", "0"), ("100", "150", "0")]
    got = _price(spark, [(D(b), "FIXED_AMOUNT", D(v)) for b, v, _ in cases])
    assert got == [D(e).quantize(D("0.01")) for _, _, e in cases]


def test_invalid_inputs(spark):
    df = spark.createDataFrame([(D("-1"), None, None), (D("10"), "PERCENTAGE", D("0")),
                                (D("10"), "FIXED_AMOUNT", D("-5")), (D("10"), "PERCENTAGE", D("5"))],
                               "base decimal(18,6), t string, v decimal(18,6)")
    errs = [r[0] for r in df.select(M.price_input_error("base", "t", "v")).collect()]
    assert errs == ["basePrice must be >= 0", "discountValue must be > 0", "discountValue must be > 0", None]
    with pytest.raises(Exception):
        df.limit(1).select(M.effective_price_strict("base", "t", "v")).collect()


def test_rounding_and_format(spark):
    vals = ["1.005", "1.004", "1.015", "2.554", "2.555", "0", "100"]
    df = spark.createDataFrame([(D(v),) for v in vals], "m decimal(18,6)")
    got = [r[0] for r in df.select(M.to_scale("m")).collect()]
    assert [str(g) for g in got] == ["1.010000", "1.000000", "1.020000", "2.550000", "2.560000",
                                     "0E-6", "100.000000"] or \
        [D(g).quantize(D("0.01")) for g in got] == [D(x) for x in
                                                    ["1.01", "1.00", "1.02", "2.55", "2.56", "0.00", "100.00"]]
    txt = spark.createDataFrame([(D("1"),), (D("1.5"),), (D("1.005"),), (D("0"),)], "m decimal(18,6)")
    assert [r[0] for r in txt.select(M.format_money("m")).collect()] == ["1.00", "1.50", "1.01", "0.00"]
    clamp = spark.createDataFrame([(D("-5"),), (D("5"),), (D("0"),)], "m decimal(12,2)")
    assert [r[0] for r in clamp.select(M.max_zero("m")).collect()] == [D("0.00"), D("5.00"), D("0.00")]
    s = spark.range(1).select((F.lit(D("0.1")) + F.lit(D("0.2"))).alias("x")).first()["x"]
    assert s == D("0.3")


def test_feed_pricing_rules(spark):
    cases = [("99.995", None, "100.00"), ("49.50", None, "49.50"), ("15.00", "10.00", "15.00"),
             ("10.50", "10.00", "11.00"), ("8.00", "10.00", "11.00")]
    df = spark.createDataFrame([(b, c) for b, c, _ in cases], "b string, c string")
    got = df.select(M.margin_floor_price(F.col("b").cast("decimal(28,16)"),
                                         F.col("c").cast("decimal(28,16)")).cast("decimal(12,2)")).collect()
    assert [r[0] for r in got] == [D(e) for _, _, e in cases]


def test_sql_function_inlined(spark):
    M.register_sql_functions(spark)
    df = spark.sql("SELECT compute_effective_price(CAST(100 AS DECIMAL(12,2)), 'PERCENTAGE', "
                   "CAST(25 AS DECIMAL(12,2))) AS p")
    assert df.first()["p"] == D("75.00")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
