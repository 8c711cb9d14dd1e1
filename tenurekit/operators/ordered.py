"""Ordered operators that stay parallel when one key, moment or value range dominates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenurekit.operators.ranges import with_range


def running_totals(df: DataFrame, order: str, measures: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Add ``<measure>_before``, its total over smaller values of ``order``, and ``<measure>_total``.

    Rows must be unique per value. They are cut into ranges at their own quantiles, however the values are spread; each
    range is scanned on its own, and only the totals of ranges are scanned in one place. A null value comes first.
    """
    cut = with_range(df, [*within, order])
    everything = Window.partitionBy(*within)
    earlier_ranges = everything.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*within, "_range")
        .agg(*(F.sum(m).alias(m) for m in measures))
        .select(
            *within,
            "_range",
            *(F.coalesce(F.sum(m).over(earlier_ranges), F.lit(0)).alias(f"_{m}") for m in measures),
            *(F.sum(m).over(everything).alias(f"{m}_total") for m in measures),
        )
    )
    earlier_rows = Window.partitionBy(*within, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = {f"{m}_before": F.coalesce(F.sum(m).over(earlier_rows), F.lit(0)) for m in measures}
    joined = cut.withColumns(inside).join(offsets, [*within, "_range"])
    total = {f"{m}_before": F.col(f"{m}_before") + F.col(f"_{m}") for m in measures}
    return joined.withColumns(total).drop("_range", *(f"_{m}" for m in measures))


def with_previous_known(
    df: DataFrame, key: str, moment: str, tie: str, columns: Sequence[str], prefix: str = "previous_"
) -> DataFrame:
    """For each row, the last non-null value of each column on an earlier row of the same key.

    A fold over ranges of (key, moment): "the last known value, and whose" combines associatively, so each range reports
    one row and is given one, and a key, a day or a moment with very many rows is spread over ranges. A row without a
    moment comes first, as in an ascending sort; rows equal in moment and tie follow their values.
    """
    order = [key, moment, tie, *columns]
    cut = with_range(df, order)
    known = {c: F.when(F.col(c).isNotNull(), F.struct(*order[:3], F.col(c).alias("_known"))) for c in columns}
    earlier_ranges = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    carried = (
        cut.groupBy("_range")
        .agg(*(F.max(value).alias(f"_{c}") for c, value in known.items()))
        .select(F.col("_range").alias("at"), F.struct(*(F.max(f"_{c}").over(earlier_ranges).alias(c) for c in columns)).alias("carry"))
        .agg(F.map_from_entries(F.collect_list(F.struct("at", "carry"))).alias("carries"))
    )
    scanned = cut.withColumn("_carry", F.element_at(carried.scalar(), F.col("_range")))
    before = Window.partitionBy("_range", key).orderBy(moment, tie, *columns).rowsBetween(Window.unboundedPreceding, -1)

    def previous(c: str) -> Column:
        last = F.col(f"_carry.{c}")
        return F.coalesce(F.last(c, ignorenulls=True).over(before), F.when(last[key].eqNullSafe(F.col(key)), last["_known"]))

    return scanned.withColumns({f"{prefix}{c}": previous(c) for c in columns}).drop("_range", "_carry")
