"""Column helpers with the null rules that every operator shares.

A comparison with null is false; extremes and means across columns skip nulls; a rolling aggregate is null until its
frame holds enough values; division by zero gives null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

BY_SYMBOL = ("symbol",)


def by_date(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or BY_SYMBOL)).orderBy("session_date")


def true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def mean_of(columns: list[Column]) -> Column:
    """Mean of the values that are not null."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns])
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in columns])
    return F.try_divide(total, n)


def rolling(agg, value: Column, window: WindowSpec, n: int, least: int | None = None) -> Column:
    """agg over the last n rows, null while fewer than `least` (n) of them have a value."""
    frame = window.rowsBetween(1 - n, 0)
    return F.when(F.count(value).over(frame) >= (least or n), agg(value).over(frame))


def cross_above(a: Column, b: Column, window: WindowSpec) -> Column:
    return true((F.lag(a).over(window) <= F.lag(b).over(window)) & (a > b))


def cross_below(a: Column, b: Column, window: WindowSpec) -> Column:
    return true((F.lag(a).over(window) >= F.lag(b).over(window)) & (a < b))


def clip(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))
