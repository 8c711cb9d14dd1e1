"""Small column expressions shared by the operators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_date(c: ColumnOrName) -> Column:
    return col(c).cast("date")


def day(value: date) -> Column:
    """Typed date literal; Spark widens it to midnight when compared with a timestamp."""
    return F.lit(value)


def days_between(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Whole calendar days from ``start`` to ``end`` (negative when reversed)."""
    return F.datediff(as_date(end), as_date(start))


def is_true(c: ColumnOrName) -> Column:
    return col(c).eqNullSafe(True)


def is_false(c: ColumnOrName) -> Column:
    return col(c).eqNullSafe(False)


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.when(condition, 1).otherwise(0)


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def ratio(numerator: ColumnOrName, denominator: ColumnOrName, places: int, scale: int = 1) -> Column:
    """``scale * numerator / denominator`` in exact decimals, rounded half up; null over zero."""
    top = col(numerator).cast("decimal(20,0)") * F.lit(scale)
    bottom = F.nullif(col(denominator).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return F.round(top / bottom, places).cast("double")


def percent(numerator: ColumnOrName, denominator: ColumnOrName, places: int = 1) -> Column:
    return ratio(numerator, denominator, places, scale=100)


def mean(total: ColumnOrName, n: ColumnOrName) -> Column:
    """Average from a pre-aggregated sum and count; null over zero."""
    return F.try_divide(col(total).cast("double"), col(n).cast("double"))
