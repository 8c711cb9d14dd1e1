"""Distribution summaries per group: histogram, kernel density, box plot numbers."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenurekit.operators.ordered import running_totals


def _per_value(df: DataFrame, value: str, group: str, weight: str | None) -> DataFrame:
    measure = F.sum(weight) if weight else F.count("*")
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(F.col(group).alias("group"), F.col(value).cast("double").alias("value"))
        .agg(measure.alias("n"))
    )


def histogram(df: DataFrame, value: str, group: str, bins: int = 60, weight: str | None = None) -> DataFrame:
    """Density over equal bins between each group's extremes; the last bin is closed, empty bins
    are kept, and a single-valued group gets one unit of width around it."""
    counted = _per_value(df, value, group, weight)
    extent = counted.groupBy("group").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("n").alias("total"))
    flat = F.col("lo") == F.col("hi")
    extent = extent.select(
        "group",
        "total",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    position = F.floor((F.col("value") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))).cast("int")
    filled = counted.join(extent.select("group", "lo", "hi"), "group").select(
        "group", F.least(position, F.lit(bins - 1)).alias("bin"), "n"
    )
    every_bin = extent.select(
        "group", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), F.lit(0).cast("bigint").alias("n")
    )
    summed = filled.unionByName(every_bin).groupBy("group", "bin").agg(F.sum("n").alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    return summed.join(extent, "group").select(
        F.col("group").alias(group),
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("bin_start"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"),
        "n",
        (F.col("n") / (F.col("total") * width)).alias("density"),
    )


#: Bandwidths beyond which a value adds nothing to a grid point: less than 2e-14 of what it adds at its own place.
REACH = 8


def kernel_density(df: DataFrame, value: str, group: str = "label", points: int = 300) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth on an even grid over each group's range.

    Each distinct value adds its count's worth to the grid points within ``REACH`` bandwidths of it: a few, as the bandwidth
    shrinks with the number of rows, so continuous values do not fan out over the whole grid. The sums combine map-side, so
    what is shuffled is one row per group and grid point and task. Groups with fewer than two values or no spread have no
    density.
    """
    known = df.filter(F.col(value).isNotNull()).select(
        F.col(group).alias("group"), F.col(value).cast("double").alias("value")
    )
    shape = known.groupBy("group").agg(
        F.count("*").alias("total"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
        F.stddev_samp("value").alias("sd"),
    )
    shape = shape.filter(F.col("sd") > 0).select(
        "group", "total", "lo", "hi", (F.col("sd") * F.pow("total", F.lit(-0.2))).alias("bandwidth")
    )
    counted = known.groupBy("group", "value").agg(F.count("*").alias("n")).join(shape, "group")
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    at = F.col("lo") + F.col("point") * step
    u = (at - F.col("value")) / F.col("bandwidth")
    kernel = F.exp(-u * u / 2) * F.col("n") / (F.col("total") * F.col("bandwidth") * sqrt(2 * pi))
    # every value lies on the grid's range, so the nearest points are always among these
    first = F.greatest(F.lit(0), F.ceil((F.col("value") - REACH * F.col("bandwidth") - F.col("lo")) / step)).cast("int")
    last = F.least(F.lit(points - 1), F.floor((F.col("value") + REACH * F.col("bandwidth") - F.col("lo")) / step)).cast("int")
    near = counted.withColumns({"_first": first, "_last": last}).filter(F.col("_first") <= F.col("_last"))
    added = near.withColumn("point", F.explode(F.sequence("_first", "_last"))).select("group", "point", "lo", "hi", kernel.alias("density"))
    grid = shape.select("group", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"), "lo", "hi", F.lit(0.0).alias("density"))
    return (
        added.unionByName(grid)
        .groupBy("group", "point", "lo", "hi")
        .agg(F.sum("density").alias("density"))
        .select(F.col("group").alias(group), "point", at.alias("x"), "density")
    )


def quantiles(counted: DataFrame, probabilities: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles of ``(group, value, n)`` rows, one row per group.

    Positions are looked up in running counts, so no task holds a group's values.
    """
    ranked = running_totals(counted, "value", ["n"], ["group"])

    def value_at(index):
        here = (F.col("n_before") <= index) & (index < F.col("n_before") + F.col("n"))
        return F.max(F.when(here, F.col("value")))

    out = []
    for name, q in probabilities.items():
        position = (F.col("n_total") - 1) * F.lit(float(q))
        low = F.floor(position)
        high = F.least(low + 1, F.col("n_total") - 1)
        part = F.max(position - low)
        out.append((value_at(low) + (value_at(high) - value_at(low)) * part).alias(name))
    return ranked.groupBy("group").agg(F.max("n_total").alias("n"), *out)


def box_summary(
    df: DataFrame, value: str, group: str = "label", weight: str | None = None, reach: float = 1.5
) -> DataFrame:
    """Quartiles, whiskers at the last values within ``reach`` box lengths, and outliers beyond."""
    counted = _per_value(df, value, group, weight)
    box = quantiles(counted, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    length = F.col("q3") - F.col("q1")
    low, high = F.col("q1") - reach * length, F.col("q3") + reach * length
    v, n = F.col("value"), F.col("n")
    tails = (
        counted.join(box.drop("n"), "group")
        .groupBy("group")
        .agg(
            F.min(F.when(v >= low, v)).alias("whisker_low"),
            F.max(F.when(v <= high, v)).alias("whisker_high"),
            F.sum(F.when((v < low) | (v > high), n).otherwise(0)).alias("n_outliers"),
        )
    )
    return box.join(tails, "group").select(
        F.col("group").alias(group),
        "n",
        "q1",
        "median",
        "q3",
        F.least("whisker_low", "q1").alias("whisker_low"),
        F.greatest("whisker_high", "q3").alias("whisker_high"),
        "n_outliers",
    )


def violin(df: DataFrame, value: str, group: str = "label", points: int = 100) -> DataFrame:
    """The outline of a violin: kernel density on a coarser grid."""
    return kernel_density(df, value, group, points)

