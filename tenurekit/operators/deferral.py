"""Deferred renewals: how many, how far, and what happened next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenurekit.config import Calendar
from tenurekit.functions.columns import as_date, day, days_between, percent
from tenurekit.operators.cohort import SUB, TERM, restrict_to
from tenurekit.operators.lookback import RENEWAL_MOVED, user_deferrals


def deferrals_without_dates(events: DataFrame) -> DataFrame:
    missing = F.col("old_renewal_at").isNull() & F.col("new_renewal_at").isNull()
    return user_deferrals(events).filter(missing)


def deferral_reach(cohort: DataFrame, events: DataFrame) -> DataFrame:
    """One row: cohort size, how many deferred at least once, and how many never did."""
    deferred = user_deferrals(events).select(SUB).distinct().withColumn("did", F.lit(1))
    people = cohort.select(SUB).distinct().join(deferred, SUB, "left")
    reach = people.agg(F.count("*").alias("cohort_size"), F.count("did").alias("n_deferred"))
    return reach.select(
        "cohort_size",
        "n_deferred",
        percent("n_deferred", "cohort_size", 2).alias("pct_deferred"),
        (F.col("cohort_size") - F.col("n_deferred")).alias("n_never_deferred"),
    )


def cohort_multiplicity(cohort: DataFrame) -> DataFrame:
    """How often each subscription is in the cohort (joins to it repeat rows that often)."""
    return cohort.groupBy(SUB).agg(F.count("*").alias("times"))


def deferral_counts(cohort: DataFrame, events: DataFrame) -> DataFrame:
    """Deferrals per cohort subscription. Events are counted before the join."""
    per_sub = user_deferrals(events).groupBy(SUB).agg(F.count("*").alias("n"))
    joined = per_sub.join(cohort_multiplicity(cohort), SUB)
    return joined.select(SUB, (F.col("n") * F.col("times")).alias("n_deferrals"))


def day_gap_counts(cohort: DataFrame, events: DataFrame, start: str, end: str, name: str) -> DataFrame:
    """Events of the cohort by the days between two of their dates."""
    per_sub = events.groupBy(SUB, days_between(start, end).alias(name)).agg(F.count("*").alias("n"))
    joined = per_sub.join(cohort_multiplicity(cohort), SUB)
    return joined.groupBy(name).agg(F.sum(F.col("n") * F.col("times")).alias("n_events"))


def moved_renewals(events: DataFrame) -> DataFrame:
    """Every moved renewal with a known old date, whoever moved it."""
    return events.filter((F.col("event_name") == RENEWAL_MOVED) & F.col("old_renewal_at").isNotNull())


def renewal_outcomes(
    events: DataFrame, invoices: DataFrame, cal: Calendar, cohort: DataFrame | None = None
) -> DataFrame:
    """Per deferring subscription: its latest new date and the paid invoices from that day on.

    Only dates that leave a whole horizon to observe are kept. With ``cohort``, only invoices of its
    terms count. Invoices are counted per term and day before any join, so a hot subscription brings
    one row per day.
    """
    latest = (
        user_deferrals(events)
        .groupBy(SUB)
        .agg(F.max("new_renewal_at").alias("new_renewal_at"))
        .filter(F.col("new_renewal_at") <= day(cal.renewal_cutoff))
    )
    paid_days = (
        invoices.filter(F.col("is_paid"))
        .groupBy(SUB, TERM, as_date("created_at").alias("paid_day"))
        .agg(F.count("*").alias("n"))
    )
    if cohort is not None:
        paid_days = restrict_to(paid_days, cohort, TERM)
    after = F.when(F.col("paid_day") >= as_date("new_renewal_at"), F.col("n")).otherwise(0)
    return (
        latest.join(paid_days, SUB, "left")
        .groupBy(SUB, "new_renewal_at")
        .agg(F.sum(after).alias("n_paid_after"))
    )


def renewal_share(outcomes: DataFrame, per_subscriber: bool = False) -> DataFrame:
    """Renewed or not. A renewed subscription counts once per paid invoice by default, and once
    with ``per_subscriber``."""
    renewed = F.col("n_paid_after") > 0
    weight = F.lit(1).cast("bigint") if per_subscriber else F.greatest(F.col("n_paid_after"), F.lit(1))
    return outcomes.select(F.when(renewed, "yes").otherwise("no").alias("is_renewed"), weight.alias("rows"))


def outcome_by_deferral(
    terms: DataFrame, cohort: DataFrame, events: DataFrame, user_only: bool = False
) -> DataFrame:
    """Distinct cohort subscriptions by deferred or not, term status and termination type.

    By default any moved renewal makes a subscription deferred; ``user_only`` asks for its user.
    """
    moved = user_deferrals(events) if user_only else events.filter(F.col("event_name") == RENEWAL_MOVED)
    deferred = moved.select(SUB).distinct().withColumn("did", F.lit(1))
    rows = restrict_to(terms.select(SUB, "term_status", "termination_type").distinct(), cohort)
    grouped = rows.join(deferred, SUB, "left").withColumn(
        "deferral_group", F.when(F.col("did") == 1, "deferred").otherwise("never deferred")
    )
    return grouped.groupBy("deferral_group", "term_status", "termination_type").agg(
        F.count_distinct(SUB).alias("n_subscriptions")
    )
