"""Ranges of rows in a total order, cut at quantiles of the data itself.

A global order is what makes running totals and "last known value" hard to spread: one window over it is one task. Here
rows are cut into ranges of about equal size, whatever the values look like; each range is scanned on its own, and one row
a range carries what the next ones need. The cut points are the quantiles of a sample drawn by a hash of the rows, so
every evaluation of a plan, retried or repeated, finds the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampled rows for each range: the largest of 64 ranges holds about 1.4 times its share.
SAMPLED = 64
LEAST_RANGES = 64


def n_ranges(df: DataFrame) -> int:
    """Ranges that keep a cluster busy: twice the session's shuffle partitions."""
    return max(LEAST_RANGES, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _place(order: Sequence[str]) -> Column:
    return F.struct(*order)


def cut_points(df: DataFrame, order: Sequence[str], ranges: int) -> DataFrame:
    """One row ``cuts``: the sorted places at which the second and later ranges begin, at most ``ranges - 1``.

    The sample is the rows with the smallest hashes, a bounded number taken by each task and merged. All columns go into the
    hash, so that the input is planned with the same columns here as where it is scanned and its exchanges can be shared.
    """
    sampled = (
        df.select(_place(order).alias("place"), F.xxhash64(*df.columns).alias("hash"))
        .orderBy("hash", "place")
        .limit(ranges * SAMPLED)
        .agg(F.sort_array(F.collect_list("place")).alias("sorted"))
    )
    size = F.size("sorted")
    every = F.when(size >= 2, F.sequence(F.lit(1), F.lit(ranges - 1))).otherwise(F.array().cast("array<int>"))
    at = F.transform(every, lambda i: F.get("sorted", F.floor(i * size / ranges).cast("int")))
    return sampled.select(F.array_distinct(at).alias("cuts"))


def with_range(df: DataFrame, order: Sequence[str], name: str = "_range", ranges: int | None = None) -> DataFrame:
    """Add the number of each row's range: never falling in the order given, nulls first, NaN last."""
    ranges = ranges or n_ranges(df)
    cuts, place = F.col("_cuts"), F.col("_place")
    steps = [1 << b for b in range(ranges.bit_length() - 1, -1, -1)]

    def further(low: Column, step: Column) -> Column:
        """``low`` cuts are known not to lie after the row; are ``step`` more?"""
        return F.when(F.get(cuts, low + step - 1) <= place, low + step).otherwise(low)

    number = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further)
    placed = df.withColumns({"_cuts": cut_points(df, order, ranges).scalar(), "_place": _place(order)})
    return placed.withColumn(name, number).drop("_cuts", "_place")
