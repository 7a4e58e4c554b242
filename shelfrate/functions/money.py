"""Money arithmetic as Catalyst Column expressions (exact decimals, HALF_UP).

Spark's ``round`` on a decimal rounds half away from zero, which equals
HALF_UP for the non-negative amounts handled here (and is symmetric for
negatives, matching decimal.js HALF_UP as well).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from shelfrate.schemas import MONEY

# Fixed values (must equal the reference's): money scale and the
# minimum margin of the feed pricing rule, in percent.
MONEY_SCALE = 2
MIN_MARGIN_PCT = 10



# Literals are built per call: module import must not need a SparkContext
# (Python workers import this module too).
def _zero() -> Column:
    return F.lit(Decimal("0"))


def _hundred() -> Column:
    return F.lit(Decimal("100"))


def _cent() -> Column:
    return F.lit(Decimal("0.01"))


def _margin_factor() -> Column:
    return F.lit(Decimal(100 + MIN_MARGIN_PCT) / Decimal(100))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def money(text) -> Column:
    """Parse text to a wide decimal; NULL when it is not a number."""
    return F.expr(f"try_cast({_sql(text)} as decimal(28,16))") if isinstance(text, str) \
        else text.try_cast("decimal(28,16)")


def _sql(name: str) -> str:
    return f"`{name}`"


def max_zero(m) -> Column:
    """Floor at zero; NULL stays NULL (``greatest`` alone would skip it)."""
    m = _c(m)
    return F.when(m.isNull(), F.lit(None)).otherwise(F.greatest(m, _zero()))


def to_scale(m) -> Column:
    """Round to 2 decimals HALF_UP."""
    return F.round(_c(m), MONEY_SCALE)


def as_money(m) -> Column:
    """Round and cast to the stored money type decimal(12,2)."""
    return to_scale(m).cast(MONEY)


def format_money(m) -> Column:
    """2-decimal text, e.g. ``1.50``."""
    return as_money(m).cast("string")


def raw_discounted(base, discount_type, discount_value) -> Column:
    """Price under a discount before rounding and flooring (NULL without a type)."""
    base, t, v = _c(base), _c(discount_type), _c(discount_value)
    return (F.when(t == "PERCENTAGE", base * (_hundred() - v) * _cent())
            .when(t == "FIXED_AMOUNT", base - v))


def effective_price(base, discount_type=None, discount_value=None) -> Column:
    """Price the customer pays.

    PERCENTAGE: base * (1 - v/100); FIXED_AMOUNT: base - v; floored at 0,
    rounded HALF_UP to 2 decimals, typed decimal(12,2). Without a discount
    type the result is the base price itself (rounded); a NULL base gives
    NULL.
    """
    base = _c(base)
    if discount_type is None:
        return as_money(base)
    priced = max_zero(to_scale(raw_discounted(base, discount_type, discount_value)))
    return F.when(_c(discount_type).isNull(), as_money(base)).otherwise(priced.cast(MONEY))


def price_input_error(base, discount_type=None, discount_value=None) -> Column:
    """Why ``effective_price`` inputs are invalid, or NULL when fine."""
    base = _c(base)
    err = F.when(base < 0, F.lit("basePrice must be >= 0"))
    if discount_type is not None:
        err = err.when(_c(discount_type).isNotNull() & (_c(discount_value) <= 0),
                       F.lit("discountValue must be > 0"))
    return err


def effective_price_strict(base, discount_type=None, discount_value=None) -> Column:
    """X5 with V15 enforced: invalid inputs fail the query (``raise_error``)."""
    err = price_input_error(base, discount_type, discount_value)
    return F.when(err.isNotNull(), F.raise_error(err).cast(MONEY)).otherwise(
        effective_price(base, discount_type, discount_value))


def margin_floor_price(base, vendor_cost) -> Column:
    """Lift the base price to cost * 1.10 when below it, then 2 decimals."""
    base, cost = _c(base), _c(vendor_cost)
    floor = cost * _margin_factor()
    lifted = F.when(cost.isNotNull() & (base < floor), floor).otherwise(base)
    return to_scale(lifted)


def register_sql_functions(spark: SparkSession) -> None:
    """SQL twin of X5, inlined by the analyzer (no Python in the plan)."""
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION compute_effective_price(
            base_price DECIMAL(12,2), d_type STRING, d_value DECIMAL(12,2))
        RETURNS DECIMAL(12,2)
        RETURN CAST(CASE
            WHEN base_price IS NULL THEN NULL
            WHEN d_type IS NULL THEN round(base_price, 2)
            ELSE greatest(round(CASE
                WHEN d_type = 'PERCENTAGE' THEN base_price * (100 - d_value) * 0.01
                WHEN d_type = 'FIXED_AMOUNT' THEN base_price - d_value END, 2), 0)
            END AS DECIMAL(12,2))
    """)
