"""Subscribers who push their renewal back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenurekit.operators import deferral as df_
from tenurekit.operators import summaries as sm
from tenurekit.operators.cohort import SUB
from tenurekit.operators.lookback import user_deferrals
from tenurekit.plans.registry import named


@named("qd_1_deferrals_without_dates")
def _(lake):
    rows = df_.deferrals_without_dates(lake.raw_events)
    return rows.select(SUB, "event_name", "changed_by", "old_renewal_at", "new_renewal_at")


@named("qd_2_event_volume")
def _(lake):
    per_sub = lake.raw_events.groupBy("event_name", "changed_by", SUB).agg(F.count("*").alias("n"))
    volume = per_sub.groupBy("event_name", "changed_by").agg(
        F.sum("n").alias("n_events"), F.count("*").alias("n_subscriptions")
    )
    return volume.orderBy(F.desc("n_events"))


@named("qd_3_deferral_reach")
def _(lake):
    return df_.deferral_reach(lake.qualified, lake.raw_events)


@named("qd_4_deferral_counts")
def _(lake):
    per_sub = df_.deferral_counts(lake.qualified, lake.raw_events)
    return sm.counts(per_sub, ["n_deferrals"], n="n_subscriptions").orderBy("n_deferrals")


@named("qd_5_days_deferred")
def _(lake):
    moved = user_deferrals(lake.raw_events, with_both_dates=True)
    days = df_.day_gap_counts(lake.qualified, moved, "old_renewal_at", "new_renewal_at", "days_deferred")
    return days.orderBy(F.desc("n_events"))


def _outcomes(lake):
    invoices = lake.cohort_rows("subscription_invoices")
    return df_.renewal_outcomes(lake.raw_events, invoices, lake.calendar, lake.qualified)


def _renewed(lake, per_subscriber):
    rows = df_.renewal_share(_outcomes(lake), per_subscriber)
    share = sm.share(rows, ["is_renewed"], weight="rows", places=2, n="n_subscriptions", name="pct_subscriptions")
    return share.orderBy(F.desc("n_subscriptions"))


@named("qd_6_renewed_after_deferral")
def _(lake):
    return _renewed(lake, per_subscriber=False)


@named("qd_6_renewed_after_deferral_per_subscriber")
def _(lake):
    return _renewed(lake, per_subscriber=True)


@named("qd_7_ten_not_renewed")
def _(lake):
    """Ten subscriptions to look at, in id order."""
    rows = _outcomes(lake).filter(F.col("n_paid_after") == 0)
    return rows.select(SUB, "new_renewal_at").orderBy(SUB).limit(10)


@named("qd_8_outcome_by_deferral")
def _(lake):
    rows = df_.outcome_by_deferral(lake.terms, lake.qualified, lake.raw_events)
    return rows.orderBy("deferral_group", F.desc("n_subscriptions"))


@named("qd_8_outcome_by_user_deferral")
def _(lake):
    return df_.outcome_by_deferral(lake.terms, lake.qualified, lake.raw_events, user_only=True)


@named("qd_9_days_before_renewal")
def _(lake):
    moved = df_.moved_renewals(lake.raw_events)
    days = df_.day_gap_counts(lake.qualified, moved, "occurred_at", "old_renewal_at", "days_before_renewal")
    return days.orderBy("days_before_renewal")
