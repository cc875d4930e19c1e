"""Exact money arithmetic on integer cents.

Summing DECIMAL(14,2) needs a 24-digit buffer, which Spark holds as an object per
group; summing BIGINT cents stays a primitive add inside generated code and is just
as exact (an overflow raises under ANSI mode instead of wrapping).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def cents(amount: str | Column) -> Column:
    """DECIMAL(.,2) amount as BIGINT cents."""
    return (as_column(amount).cast("decimal(14,2)") * F.lit(100)).cast("bigint")


def money(hundredths: str | Column, precision: int = 18) -> Column:
    """BIGINT hundredths as DECIMAL(precision,2)."""
    exact = as_column(hundredths).cast("decimal(19,0)") * F.lit("0.01").cast("decimal(2,2)")
    return exact.cast(f"decimal({precision},2)")


def integer_div(numerator: Column, denominator: Column) -> Column:
    """SQL ``div``: truncating integer division."""
    return F.call_function("div", numerator, denominator)


def ratio_2dp(
    hundredths: str | Column, count: str | Column, precision: int = 18, times: int = 1
) -> Column:
    """times * (hundredths / 100) / count, rounded half away from zero to 2 decimals.

    A zero or NULL count gives NULL. Integer arithmetic only, so ties are exact; it
    runs on aggregated rows, so wide decimals cost nothing and cannot overflow.
    """
    num = as_column(hundredths).cast("decimal(24,0)") * F.lit(times)
    den = F.nullif(as_column(count).cast("decimal(24,0)"), F.lit(0).cast("decimal(24,0)"))
    size = F.abs(den)
    rounded = integer_div(F.abs(num) * 2 + size, size * 2)
    negative = (num < 0) != (den < 0)
    return money(F.when(negative, -rounded).otherwise(rounded), precision)
