"""The derived tables themselves: extraction, conformed tables, cohorts, labels, features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from tenurekit.functions.buckets import subscriber_type
from tenurekit.operators import cohort as co
from tenurekit.operators.features import plan_at_snapshots
from tenurekit.plans.pipeline import feature_table
from tenurekit.plans.registry import named
from tenurekit.sources import extract

SUB, TERM = co.SUB, co.TERM


def plain(df: DataFrame) -> DataFrame:
    """Money as double, for comparison across engines."""
    money = {f.name: F.col(f.name).cast("double") for f in df.schema if isinstance(f.dataType, DecimalType)}
    return df.withColumns(money) if money else df


# ---------------------------------------------------------------- extraction filters


@named("ex1_subscriptions")
def _(lake):
    rows = extract.by_exact_condition(lake.people, lake.condition)
    return rows.select(SUB, "condition_name", "status")


@named("ex2_terms")
def _(lake):
    return extract.by_condition(lake.terms, lake.condition).select(TERM, SUB, "condition_name", "term_status")


@named("ex3_plan_terms")
def _(lake):
    rows = extract.by_condition(lake.source["subscription_plan_terms"], lake.condition)
    return rows.select("subscription_plan_term_id", TERM, "condition_name")


@named("ex4_charges")
def _(lake):
    rows = extract.by_condition(lake.source["subscription_charges"], lake.condition)
    return rows.select("charge_id", "invoice_id", SUB, "attempt_number")


@named("ex5_invoices")
def _(lake):
    rows = extract.invoices_of(lake.source["subscription_invoices"], lake.condition)
    return rows.select("invoice_id", TERM, "subscription_subcategory")


@named("ex6_churn_rows")
def _(lake):
    rows = extract.churn_rows_of(lake.source["subscriptions_churn"], lake.condition)
    return rows.select("common_id", TERM, "subscription_name", "is_reactivated_term")


@named("ex7_plan_types")
def _(lake):
    return extract.plan_types_of(lake.source["subscription_plan_types"])


@named("ex8_events")
def _(lake):
    rows = extract.events_of(lake.raw_events, lake.condition)
    return rows.select("event_id", "event_name", SUB)


def _orders(lake, how):
    invoices = lake.source["subscription_invoices"]
    return extract.orders_of(lake.source["subscription_orders"], invoices, lake.condition, how).select(
        "order_id", "status"
    )


@named("ex9_orders_per_invoice")
def _(lake):
    return _orders(lake, "inner")


@named("ex9_orders_once")
def _(lake):
    return _orders(lake, "left_semi")


# ---------------------------------------------------------------- conformed tables


@named("sv1_qualified_cohort")
def _(lake):
    return lake.qualified


@named("sv2_plan_types")
def _(lake):
    return lake.plan_types


@named("sv3_subscriptions")
def _(lake):
    return lake.silver_subscriptions


@named("sv4_all_terms")
def _(lake):
    return lake.all_terms


@named("sv5_plan_terms")
def _(lake):
    return lake.plan_terms


@named("sv6_charges")
def _(lake):
    return plain(lake.charges)


@named("sv7_invoices")
def _(lake):
    return plain(lake.invoices)


@named("sv8_events")
def _(lake):
    return plain(lake.events)


@named("sv9_start_labels")
def _(lake):
    return lake.labels


@named("sv10_weekly_snapshots")
def _(lake):
    return lake.snapshots


@named("sv11_refined_cohort")
def _(lake):
    return lake.refined


@named("sv12_labels_refined")
def _(lake):
    return lake.labels_refined


@named("sv13_cancellation_type")
def _(lake):
    return lake.typed.select(SUB, TERM, "cancellation_type")


@named("sv14_valid_cohort")
def _(lake):
    return co.repeat_rows(lake.valid.select(SUB, TERM, "cancellation_type", "n_rows"))


@named("sv14_valid_cohort_on_term")
def _(lake):
    rows = co.valid_cohort(lake.typed, lake.terms, on_term=True)
    return rows.select(SUB, TERM, "cancellation_type")


@named("sv15_single_plan_subscriptions")
def _(lake):
    return co.single_plan_subscriptions(lake.source["subscription_plan_terms"])


@named("sv16_first_plan_activated")
def _(lake):
    return co.first_plan_of_activated(lake.people, lake.source["subscription_plan_terms"])


@named("sv17_wanted_plan_fell_out")
def _(lake):
    return co.wanted_plan_of_fell_out(lake.people, lake.plan_types)


@named("sv18_latest_plan")
def _(lake):
    plan = lake.latest_plan("drug_name", "drug_strength", "regimen", "term_months", "monthly_dose")
    return lake.refined.join(plan, TERM)


@named("g1_snapshot_features")
def _(lake):
    return feature_table(lake)


@named("g1_snapshot_features_strict")
def _(lake):
    return feature_table(lake, strict=True)


@named("g1_plan_at_snapshot")
def _(lake):
    return plan_at_snapshots(lake.bounds, lake.plan_steps, lake.calendar)


@named("bk5_subscriber_types_per_term")
def _(lake):
    kind = subscriber_type("cancel_requested_at", "term_ended_at")
    return lake.bounds.select(TERM, kind.alias("subscriber_type"), "last_week")
