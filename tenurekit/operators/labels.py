"""Cancellation labels: one per term, and one per weekly snapshot of a term."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenurekit.config import Calendar
from tenurekit.functions.columns import as_date, day, flag
from tenurekit.operators.cohort import SUB, TERM


def start_label(terms: DataFrame, cal: Calendar) -> DataFrame:
    """Label each cohort term at its start.

    ``is_cancelled`` covers day 0 to the horizon; ``cancel_status`` sets day 0 apart. Terms that had
    ended by the cutoff without a request are dropped; that test looks at the end's timestamp, so an
    end later on the cutoff day itself stays.
    """
    started, cancelled = as_date("term_started_at"), as_date("cancel_requested_at")
    day_1, day_n = F.date_add(started, 1), F.date_add(started, cal.horizon_days)
    status = (
        F.when(cancelled.between(day_1, day_n), "cancelled_in_30_days")
        .when(cancelled == started, "cancelled_at_start")
        .otherwise("not_cancelled")
    )
    ended_silently = F.col("cancel_requested_at").isNull() & (F.col("term_ended_at") <= day(cal.label_cutoff))
    return terms.filter(~F.coalesce(ended_silently, F.lit(False))).select(
        SUB,
        TERM,
        started.alias("term_started_at"),
        as_date("term_ended_at").alias("term_ended_at"),
        day_1.alias("day_1_after_start"),
        day_n.alias("day_30_after_start"),
        cancelled.alias("cancel_requested_at"),
        flag(cancelled.between(started, day_n)).alias("is_cancelled"),
        status.alias("cancel_status"),
    )


def snapshot_bounds(terms: DataFrame, cal: Calendar, carry: Sequence[str] = ()) -> DataFrame:
    """One row per term that has snapshots: its dates and the number of its last week, and columns to carry along.

    Every stop rule is monotone in the week, so the last week has a closed form:

    * cancelled by the cutoff: snapshots strictly before the cancel;
    * ended by the cutoff without a request: the whole horizon must fit before the end;
    * otherwise: the whole horizon must fit before the cutoff.
    """
    limit = day(cal.label_cutoff)
    requested = as_date("cancel_requested_at")
    dated = terms.select(
        SUB,
        TERM,
        as_date("term_started_at").alias("term_started_at"),
        as_date("term_ended_at").alias("term_ended_at"),
        F.when(requested <= limit, requested).alias("cancel_requested_at"),
        *carry,
    )
    started, ended, cancelled = F.col("term_started_at"), F.col("term_ended_at"), F.col("cancel_requested_at")
    room = (
        F.when(cancelled.isNotNull(), F.datediff(cancelled, started) - 1)
        .when(ended <= limit, F.datediff(ended, started) - cal.horizon_days)
        .otherwise(F.datediff(limit, started) - cal.horizon_days)
    )
    last = F.least(F.floor(room / cal.step_days), F.lit(cal.max_week)).cast("int")
    return dated.withColumn("last_week", last).filter(F.col("last_week") >= 0)


def cancels_within(cancelled: Column, snapshot: Column, horizon_days: int) -> Column:
    return flag(cancelled.between(F.date_add(snapshot, 1), F.date_add(snapshot, horizon_days)))


def with_snapshot(bounds: DataFrame, cal: Calendar) -> DataFrame:
    """Snapshot date and label of rows that carry their term's dates and a ``week_number``."""
    snapshot = F.date_add("term_started_at", F.col("week_number") * cal.step_days)
    return bounds.withColumn("snapshot_date", snapshot).withColumn(
        "label", cancels_within(F.col("cancel_requested_at"), F.col("snapshot_date"), cal.horizon_days)
    )


def term_outcomes(bounds: DataFrame, cal: Calendar) -> DataFrame:
    """The distinct labels among each term's snapshots, without listing the snapshots.

    A label never falls back from 1 to 0 as weeks pass, so the first and the last week show them all.
    """
    started, cancelled = F.col("term_started_at"), F.col("cancel_requested_at")
    last = F.date_add(started, F.col("last_week") * cal.step_days)
    ends = [cancels_within(cancelled, snapshot, cal.horizon_days) for snapshot in (started, last)]
    return bounds.select(SUB, TERM, F.explode(F.array_distinct(F.array(*ends))).alias("label"))


def weekly_snapshots(bounds: DataFrame, cal: Calendar) -> DataFrame:
    """One row per term and week from the start on: a narrow map, no join and no wasted rows."""
    weeks = F.explode(F.sequence(F.lit(0), F.col("last_week"))).alias("week_number")
    rows = bounds.select(SUB, TERM, "term_started_at", "term_ended_at", "cancel_requested_at", weeks)
    return with_snapshot(rows, cal).select(
        SUB,
        TERM,
        "term_started_at",
        "term_ended_at",
        "cancel_requested_at",
        "snapshot_date",
        "week_number",
        (F.col("week_number") * cal.step_days).alias("days_since_term_start"),
        "label",
    )
