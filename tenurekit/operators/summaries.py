"""Shares, rates, histograms and period counts: the verbs most reports are made of.

All of them aggregate first; windows and sorts only ever see the grouped rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenurekit.functions.columns import ColumnOrName, col, count_where, percent
from tenurekit.operators.cohort import SUB

Dims = Sequence[str]


def counts(df: DataFrame, by: Dims, *, distinct: str | None = None, weight: str | None = None, n: str = "n") -> DataFrame:
    """Rows per group, or distinct values of one column, or the sum of a multiplicity."""
    if distinct is not None:
        measure = F.count_distinct(distinct)
    elif weight is not None:
        measure = F.sum(weight)
    else:
        measure = F.count("*")
    return df.groupBy(*by).agg(measure.cast("bigint").alias(n))


def with_share(
    grouped: DataFrame, n: str = "n", *, within: Dims = (), places: int = 1, name: str = "pct"
) -> DataFrame:
    """Each group's percentage of the total, or of the total of its ``within`` columns."""
    total = F.sum(n).over(Window.partitionBy(*within))
    return grouped.withColumn(name, percent(F.col(n), total, places))


def share(
    df: DataFrame,
    by: Dims,
    *,
    distinct: str | None = None,
    weight: str | None = None,
    within: Dims = (),
    places: int = 1,
    n: str = "n",
    name: str = "pct",
) -> DataFrame:
    return with_share(counts(df, by, distinct=distinct, weight=weight, n=n), n, within=within, places=places, name=name)


def rate_by(
    df: DataFrame,
    dims: Dims,
    hit: Column,
    *,
    subject: str = SUB,
    n: str = "n_subscribers",
    n_hit: str = "n_cancelled",
    name: str = "cancel_rate_pct",
    places: int = 1,
    min_n: int = 0,
) -> DataFrame:
    """Distinct subjects, rows that hit, and the percentage, per group (or overall without dims)."""
    grouped = df.groupBy(*dims).agg(F.count_distinct(subject).alias(n), count_where(hit).alias(n_hit))
    if min_n:
        grouped = grouped.filter(F.col(n) >= min_n)
    return grouped.withColumn(name, percent(n_hit, n, places))


def period_counts(df: DataFrame, moment: ColumnOrName, unit: str, name: str) -> DataFrame:
    """Rows per calendar month or (Monday-based) week."""
    return counts(df.select(F.date_trunc(unit, col(moment)).cast("date").alias(name)), [name])


def funnel(df: DataFrame, steps: dict[str, Column], *, subject: str = SUB, entry: str = "signup") -> DataFrame:
    """One row: distinct subjects, then rows reaching each step and their percentage of the entry."""
    reached = df.agg(
        F.count_distinct(subject).alias(entry), *(count_where(reach).alias(step) for step, reach in steps.items())
    )
    out = [F.col(entry)]
    for step in steps:
        out += [F.col(step), percent(step, entry, 1).alias(f"pct_{step}")]
    return reached.select(*out)


def spread_columns(df: DataFrame, rows: str, columns: str, values: dict, measure: Column) -> DataFrame:
    """Pivot over a known value list, so Spark needs no extra pass to discover it."""
    wide = df.groupBy(rows).pivot(columns, list(values)).agg(measure)
    return wide.select(rows, *(F.col(str(value)).alias(name) for value, name in values.items()))
