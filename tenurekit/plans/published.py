"""Result tables reported without their queries; definitions follow their headers.

All are over the qualified cohort. "Cancelled in 30 days" counts requests from the start day to day
30, and no term is dropped.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tenurekit.functions.columns import as_date
from tenurekit.operators import summaries as sm
from tenurekit.operators.cohort import SUB, TERM, join_split
from tenurekit.plans.registry import named

COUNT, HITS, PCT = "count_subscribers", "cnt_cancel_requested_in_30d", "cnt_cancel_pct"


def _terms(lake):
    started, cancelled = as_date("term_started_at"), as_date("cancel_requested_at")
    in_window = cancelled.between(started, F.date_add(started, lake.calendar.horizon_days))
    return lake.cohort_terms.withColumn("in_30_days", F.coalesce(in_window, F.lit(False)))


def _rate(rows, dims, places=6):
    return sm.rate_by(rows, dims, F.col("in_30_days"), n=COUNT, n_hit=HITS, name=PCT, places=places)


def _with_cadence(lake):
    return _terms(lake).join(lake.latest_plan(F.col("term_months").alias("cadence_months")), TERM)


@named("qr_1_term_status")
def _(lake):
    return sm.counts(lake.cohort_terms, ["term_status"], distinct=SUB, n=COUNT)


@named("qr_2_overall_rate")
def _(lake):
    return _rate(_terms(lake), [])


@named("qr_3_rate_by_cadence")
def _(lake):
    return _rate(_with_cadence(lake), ["cadence_months"]).orderBy("cadence_months")


@named("qr_4_cadence_by_term_status")
def _(lake):
    by = ["cadence_months", "term_status"]
    return _rate(_with_cadence(lake), by).drop(PCT).orderBy(*by)


@named("qr_5_rate_by_cadence_and_plan_changes")
def _(lake):
    changes = lake.plan_steps.groupBy(TERM).agg((F.count("*") - 1).alias("plan_change_count"))
    by = ["cadence_months", "plan_change_count"]
    return _rate(_with_cadence(lake).join(changes, TERM), by).orderBy(*by)


@named("qr_6_rate_by_cadence_and_refills")
def _(lake):
    paid = lake.cohort_rows("subscription_invoices").filter(F.col("is_paid"))
    fills = paid.groupBy(TERM).agg(F.count("*").alias("fills"))
    refills = F.greatest(F.coalesce(F.col("fills"), F.lit(0)) - 1, F.lit(0)).alias("refill_count")
    rows = _with_cadence(lake).join(fills, TERM, "left").select(SUB, "in_30_days", "cadence_months", refills)
    by = ["cadence_months", "refill_count"]
    return _rate(rows, by).orderBy(*by)


def _latest(*columns):
    def analysis(lake):
        plan = lake.latest_plan(*(F.col(c).alias(f"latest_{c}") for c in columns))
        by = [f"latest_{c}" for c in columns]
        return _rate(_terms(lake).join(plan, TERM), by).orderBy(F.desc(PCT))

    return analysis


named("qr_7_rate_by_latest_drug")(_latest("drug_name"))
named("qr_8_rate_by_latest_drug_and_strength")(_latest("drug_name", "drug_strength"))


def _visits(lake):
    """Distinct visits per term between its subscription's activation and its cancel. Invoices fold to one row per
    (term, visit, day) before the join."""
    days = (
        lake.cohort_rows("subscription_invoices")
        .filter(F.col("visit_id").isNotNull())
        .select(TERM, "visit_id", as_date("created_at").alias("visit_day"))
        .distinct()
    )
    activated = lake.people.select(SUB, as_date("activated_at").alias("from_day"))
    terms = _terms(lake).select(SUB, TERM, as_date("cancel_requested_at").alias("to_day"), "in_30_days")
    span = join_split(terms, activated, SUB)
    inside = (F.col("visit_day") >= F.col("from_day")) & (
        F.col("to_day").isNull() | (F.col("visit_day") <= F.col("to_day"))
    )
    return (
        days.join(span, TERM)
        .filter(inside)
        .groupBy(SUB, TERM, "in_30_days", F.col("to_day").isNotNull().alias("cancelled"))
        .agg(F.count_distinct("visit_id").alias("visit_count"))
    )


def _visit_rate(hit, n_hit):
    def analysis(lake):
        rates = sm.rate_by(
            _visits(lake), ["visit_count"], F.col(hit), n="total_subscribers", n_hit=n_hit, name="cancel_rate_pct", places=2
        )
        return rates.orderBy("visit_count")

    return analysis


named("qr_9_cancel_rate_by_visits")(_visit_rate("cancelled", "cancelled_subscribers"))
named("qr_10_rate_by_visits")(_visit_rate("in_30_days", "cancel_requested_in_30d"))
