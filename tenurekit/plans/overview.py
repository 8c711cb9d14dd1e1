"""What the refined cohort looks like."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenurekit.functions.columns import is_true
from tenurekit.operators import summaries as sm
from tenurekit.operators.cohort import SUB, TERM
from tenurekit.plans.registry import named
from tenurekit.plans.sanity import cohort_size, refined_with_flag

STATUS = "cancel_status_before_cutoff"


@named("q01_1_refined_cohort_size")
def _(lake):
    return cohort_size(lake.refined)


@named("q01_2_starts_per_month")
def _(lake):
    months = sm.period_counts(lake.refined_terms, "term_started_at", "month", "term_start_month")
    return months.orderBy(F.desc("term_start_month"))


@named("q01_3_cancel_status_share_ordered")
def _(lake):
    return sm.share(refined_with_flag(lake), [STATUS], places=2).orderBy(F.desc("n"))


@named("q01_4_cancels_per_month")
def _(lake):
    cancelled = refined_with_flag(lake).filter(is_true("is_cancelled_before_cutoff"))
    return sm.period_counts(cancelled, "cancel_requested_at", "month", "cancel_month").orderBy("cancel_month")


@named("q01_5_cancel_status_share")
def _(lake):
    return sm.share(refined_with_flag(lake), [STATUS], places=2)


@named("q01_6_start_label_share")
def _(lake):
    labels = lake.labels.select(TERM, "cancel_status")
    return sm.share(lake.refined.join(labels, TERM, "left"), ["cancel_status"], places=2)


def _plan_share(column, name):
    def analysis(lake):
        rows = lake.refined.join(lake.latest_plan(F.col(column).alias(name)), TERM)
        return sm.share(rows, [name], distinct=SUB, n="n_subscriptions").orderBy(F.desc("pct"))

    return analysis


for _name, _column, _alias in (
    ("q01_7_share_by_drug", "drug_name", "drug_name"),
    ("q01_8_share_by_strength", "drug_strength", "drug_strength"),
    ("q01_9_share_by_regimen", "regimen", "regimen"),
    ("q01_10_share_by_cadence", "term_months", "cadence"),
):
    named(_name)(_plan_share(_column, _alias))


@named("q01_11_share_by_state")
def _(lake):
    states = lake.cohort_rows("subscriptions").select(SUB, "user_state")
    rows = lake.refined.join(states, SUB)
    return sm.share(rows, ["user_state"], distinct=SUB, n="n_subscriptions").orderBy(F.desc("n_subscriptions"))
