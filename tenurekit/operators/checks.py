"""Counts that must be zero, many per pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenurekit.config import Calendar
from tenurekit.functions.columns import as_date, count_where, day, days_between
from tenurekit.operators.cohort import SUB, TERM


def run_checks(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """One row per check: its name and the number of offending rows; the table is read once."""
    names = list(predicates)
    wide = df.agg(*(count_where(predicates[name]).alias(name) for name in names))
    return wide.unpivot([], names, "check_name", "n_bad") if len(names) > 1 else wide.select(
        F.lit(names[0]).alias("check_name"), F.col(names[0]).alias("n_bad")
    )


def label_checks(cal: Calendar) -> dict[str, Column]:
    """What the start labels promise."""
    c = F.col
    return {
        "bad_day_1": c("day_1_after_start") != F.date_add("term_started_at", 1),
        "bad_day_30": c("day_30_after_start") != F.date_add("term_started_at", cal.horizon_days),
        "misclassified_cancelled": (c("cancel_status") == "cancelled_in_30_days")
        & ~c("cancel_requested_at").between(c("day_1_after_start"), c("day_30_after_start")),
        "misclassified_at_start": (c("cancel_status") == "cancelled_at_start")
        & (c("cancel_requested_at") != c("term_started_at")),
        "window_exceeds_pull_date": c("day_30_after_start") > day(cal.label_cutoff),
        "day_1_exceeds_cutoff": c("day_1_after_start") > day(cal.start_cutoff),
    }


def snapshot_checks(cal: Calendar) -> dict[str, Column]:
    """What the weekly snapshots promise."""
    c = F.col
    snapshot, cancelled, ended = c("snapshot_date"), c("cancel_requested_at"), c("term_ended_at")
    window_end, limit = F.date_add("snapshot_date", cal.horizon_days), day(cal.label_cutoff)
    cancels = (cancelled > snapshot) & (cancelled <= window_end)
    return {
        "non_weekly_snapshots": days_between("term_started_at", "snapshot_date") % cal.step_days != 0,
        "snapshot_on_or_after_cancel": snapshot >= cancelled,
        "involuntary_window_past_end": cancelled.isNull() & (ended <= limit) & (window_end > ended),
        "retained_window_past_cutoff": cancelled.isNull()
        & (ended.isNull() | (ended > limit))
        & (window_end > limit),
        "misclassified_label_1": (c("label") == 1) & (cancelled.isNull() | ~cancels),
        "misclassified_label_0": (c("label") == 0) & cancels,
    }


def snapshot_duplicates(snapshots: DataFrame) -> DataFrame:
    """Rows against distinct (subscription, snapshot) pairs, counted without gluing keys to text."""
    pairs = snapshots.groupBy(SUB, "snapshot_date").agg(F.count("*").alias("n"))
    totals = pairs.agg(F.sum("n").alias("total_rows"), F.count("*").alias("unique_sub_snapshot_pairs"))
    return totals.withColumn("duplicates", F.col("total_rows") - F.col("unique_sub_snapshot_pairs"))


def involuntary_stop_check(snapshots: DataFrame, terms: DataFrame, cal: Calendar) -> DataFrame:
    """Snapshots of silently ended terms whose horizon passes the end recorded at the source.

    Snapshots are listed from terms, so their estimated size is that of the terms; the hint keeps Catalyst from collecting
    all of them to broadcast.
    """
    ended = terms.filter(
        F.col("cancel_requested_at").isNull() & (as_date("term_ended_at") <= day(cal.label_cutoff))
    ).select(TERM, as_date("term_ended_at").alias("source_end"))
    late = F.date_add("snapshot_date", cal.horizon_days) > F.col("source_end")
    joined = snapshots.select(TERM, "snapshot_date").hint("merge").join(ended, TERM)
    return run_checks(joined, {"involuntary_snapshot_on_or_after_term_end": late})
