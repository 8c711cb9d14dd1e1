"""Kaplan–Meier survival by stratum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenurekit.config import Calendar
from tenurekit.functions.columns import as_date, day, days_between, flag

_Z95 = 1.959963984540054


def cancel_durations(terms: DataFrame, cal: Calendar) -> DataFrame:
    """Days from start to cancel, censored at the data pull, and whether the cancel was seen.

    A cancel not later than the start's timestamp leaves the term out; one later on the same day
    stays, with duration 0.
    """
    cancelled = F.col("cancel_requested_at")
    kept = terms.filter(cancelled.isNull() | (cancelled > F.col("term_started_at")))
    until = F.coalesce(as_date(cancelled), day(cal.pull_date))
    return kept.withColumns(
        {"duration_days": days_between("term_started_at", until), "event": flag(cancelled.isNotNull())}
    )


def kaplan_meier(
    df: DataFrame, stratum: str, duration: str = "duration_days", event: str = "event", origin: bool = False
) -> DataFrame:
    """Survival at each observed duration, with the log-log 95 % band. Null strata are left out.

    Rows are counted per (stratum, duration) first, so the running sums see at most one row per
    calendar day of observation. ``origin=True`` begins each curve at time 0, where everyone is at risk; events seen on that
    day lower it there.
    """
    counted = (
        df.filter(F.col(stratum).isNotNull())
        .groupBy(stratum, duration)
        .agg(F.count("*").alias("n_leaving"), F.sum(event).alias("n_events"))
    )
    if origin:
        none = F.lit(0).cast("bigint")
        at_zero = counted.select(stratum, F.lit(0).cast(counted.schema[duration].dataType).alias(duration)).distinct()
        counted = (
            counted.unionByName(at_zero.withColumns({"n_leaving": none, "n_events": none}))
            .groupBy(stratum, duration)
            .agg(F.sum("n_leaving").alias("n_leaving"), F.sum("n_events").alias("n_events"))
        )
    by_time = Window.partitionBy(stratum).orderBy(duration)
    so_far = by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_risk = F.sum("n_leaving").over(by_time.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    n, d = F.col("at_risk"), F.col("n_events")
    everyone_left = d == n
    steps = counted.withColumn("at_risk", at_risk).withColumns(
        {
            "log_step": F.when(everyone_left, 0.0).otherwise(F.log1p(-d / n)),
            "variance_step": F.when(everyone_left, 0.0).otherwise(d / (n * (n - d).cast("double"))),
            "ended": flag(everyone_left),
        }
    )
    log_s, variance = F.sum("log_step").over(so_far), F.sum("variance_step").over(so_far)
    curve = steps.withColumns(
        {"log_s": log_s, "variance": variance, "is_zero": F.max("ended").over(so_far) == 1}
    )
    survival = F.when(F.col("is_zero"), 0.0).otherwise(F.exp("log_s"))

    def band(sign: int):
        shift = sign * _Z95 * F.sqrt("variance") / F.col("log_s")
        inside = F.exp(-F.exp(F.log(-F.col("log_s")) + shift))
        return F.when(F.col("is_zero"), None).when(F.col("log_s") == 0, 1.0).otherwise(inside)

    return curve.select(
        stratum,
        duration,
        (F.col(duration) / 30.0).alias("duration_months"),
        "at_risk",
        "n_events",
        survival.alias("survival"),
        band(-1).alias("ci_low"),
        band(+1).alias("ci_high"),
    )
