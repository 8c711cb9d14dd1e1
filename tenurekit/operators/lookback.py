"""Look-back windows: which weekly snapshots does a dated row count for?

Sources are first folded to one row per (key, day), which combines map-side and bounds what any one
key can hold. A day then names the few snapshots whose window contains it by arithmetic on the
term's start, so the join is a plain equi-join on the key with no range residual, and the number of
rows it yields is at most ``window / 7 + 1`` per day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenurekit.config import Calendar
from tenurekit.functions.buckets import outcome_group
from tenurekit.functions.columns import as_date, count_where, days_between, flag
from tenurekit.operators.cohort import SUB, TERM, join_split
from tenurekit.operators.labels import with_snapshot

# Event names and the actor that mark what the features count.
RENEWAL_MOVED = "term_renewal_time_changed"
REMINDER_SENT = "upcoming_term_renewal_notified"
RX_WRITTEN = "condition_subscription_prescription_written"
CANCELED = "canceled"
BY_USER = "CHANGED_BY_USER"


def user_deferrals(events: DataFrame, with_both_dates: bool = False) -> DataFrame:
    """Renewals a subscriber moved; optionally only those whose old and new dates are known."""
    moved = events.filter((F.col("event_name") == RENEWAL_MOVED) & (F.col("changed_by") == BY_USER))
    if with_both_dates:
        moved = moved.filter(F.col("old_renewal_at").isNotNull() & F.col("new_renewal_at").isNotNull())
    return moved


def reminders(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_name") == REMINDER_SENT)


def by_day(df: DataFrame, key: str, moment: str, *extra_keys: Column, **measures: Column) -> DataFrame:
    """One row per (key, calendar day): ``n`` rows and the given totals."""
    return (
        df.filter(F.col(moment).isNotNull())
        .groupBy(key, as_date(moment).alias("day"), *extra_keys)
        .agg(F.count("*").alias("n"), *(total.alias(name) for name, total in measures.items()))
    )


def invoice_days(invoices: DataFrame, *extra_keys: Column) -> DataFrame:
    return by_day(
        invoices,
        TERM,
        "created_at",
        *extra_keys,
        failed=count_where(F.col("is_failed")),
        delinquent=count_where(F.col("is_delinquent")),
        paid=count_where(F.col("is_paid")),
        refunded=count_where(F.col("is_refunded")),
        charges=F.sum("num_charges"),
        n_charges=F.count("num_charges"),
    )


def event_days(events: DataFrame) -> DataFrame:
    moved = days_between("old_renewal_at", "new_renewal_at")
    return by_day(events, SUB, "occurred_at", days_deferred=F.sum(moved))


def spread_over_snapshots(daily: DataFrame, bounds: DataFrame, key: str, cal: Calendar, window: int) -> DataFrame:
    """One row per (day row, snapshot whose closed window ``[snapshot - window, snapshot]`` holds it).

    Adds the snapshot's identity, label and ``age_days``, the day's distance before the snapshot.
    """
    return over_weeks(join_split(daily, bounds, key), cal, window)


def over_weeks(dated: DataFrame, cal: Calendar, window: int) -> DataFrame:
    """As ``spread_over_snapshots``, for day rows that carry their term's bounds. A row without a day goes to every snapshot."""
    offset = F.datediff("day", "term_started_at")
    first = F.greatest(F.lit(0), F.ceil(offset / cal.step_days).cast("int"))
    last = F.least(F.col("last_week"), F.floor((offset + window) / cal.step_days).cast("int"))
    touched = (
        dated.withColumns({"_first": first, "_last": last})
        .filter(F.col("_first") <= F.col("_last"))
        .withColumn("week_number", F.explode(F.sequence("_first", "_last")))
    )
    return (
        with_snapshot(touched, cal)
        .withColumn("age_days", F.datediff("snapshot_date", "day"))
        .drop("_first", "_last", "last_week")
    )


def folded_shapes(bounds: DataFrame) -> DataFrame:
    """Bounds without their terms: one row per subscription and shape (start, last week, cancel) with ``n_terms``.

    Terms of one shape have the same snapshots and labels, so a subscription's days meet its shapes, however many terms it has.
    """
    return bounds.groupBy(SUB, "term_started_at", "last_week", "cancel_requested_at").agg(F.count("*").alias("n_terms"))


def up_to_week(bounds: DataFrame, max_week: int | None) -> DataFrame:
    """Bounds without the weeks after ``max_week``, so that those are never generated."""
    if max_week is None:
        return bounds
    return bounds.withColumn("last_week", F.least(F.col("last_week"), F.lit(max_week)))


def with_outcome(df: DataFrame) -> DataFrame:
    return df.withColumn("group", outcome_group("label"))


def changed(column: str) -> Column:
    """A later plan whose known value differs from the last known one."""
    return flag((F.col("plan_term_number") > 1) & (F.col(column) != F.col(f"previous_{column}")))
