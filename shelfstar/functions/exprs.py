"""Small column helpers shared by all jobs.

Money travels as integer cents, so sums are exact and do not depend on the order in
which tasks (or re-run tasks) deliver their parts. Doubles appear only in results.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncated_cents(amount: Column) -> Column:
    """Amount in currency units -> whole cents, cut toward zero."""
    return F.when(amount >= 0, F.floor(amount * 100)).otherwise(F.ceil(amount * 100)).cast("long")


def date_key(d: Column) -> Column:
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def half_up(x: Column, digits: int) -> Column:
    """Round half up with plain double arithmetic (the same bits in every engine)."""
    scale = float(10 ** digits)
    return F.floor(x * scale + 0.5) / scale


def half_up_sql(x: str, digits: int) -> str:
    """The same rounding as text, valid in Spark SQL and in ANSI engines."""
    scale = f"1e{digits}"
    return f"(floor(({x}) * {scale} + 5e-1) / {scale})"


def sum_long(x: str) -> str:
    return f"cast(sum({x}) as bigint)"


def money(x: str) -> str:
    """Sum of a cents column as currency units."""
    return f"(sum({x}) / 1e2)"


def stddev_sql(x: str) -> str:
    """Sample standard deviation from exact integer sums (order independent)."""
    return (f"(case when count({x}) > 1 then sqrt(greatest(0e0, (sum({x} * {x}) - sum({x}) * 1e0 * sum({x}) "
            f"/ count({x})) / (count({x}) - 1))) end)")


def steady_avg(x: Column) -> Column:
    """Mean of doubles from integer millionths: independent of the order of addition."""
    return F.avg(F.floor(x * 1e6 + 0.5)) / 1e6


def steady_avg_sql(x: str) -> str:
    return f"(avg(cast(floor(({x}) * 1e6 + 5e-1) as bigint)) / 1e6)"
