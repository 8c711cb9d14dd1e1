"""Source tables restricted to the cohort and projected to their reporting columns.

Each is one semi-join and one projection: only the listed columns leave the scan, and the row side
of the join may be split by AQE when one subscription is hot. Charges and invoices, the largest tables, are not sorted for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenurekit.config import Calendar
from tenurekit.functions.columns import day, days_between
from tenurekit.operators.cohort import SUB, TERM, restrict_to

# Reporting columns of each conformed table, as (source name, reported name).
SUBSCRIPTION_COLUMNS = [
    ("subscription_id", "subscription_id"), ("common_id", "common_id"), ("activated_at", "subs_activated_at"),
    ("status", "status"), ("is_paid", "subs_is_paid"), ("is_activated", "subs_is_activated"),
    ("latest_canceled_at", "subs_latest_canceled_at"), ("latest_paused_at", "subs_latest_paused_at"),
    ("user_subscription_number", "user_subscription_number"), ("first_platform", "first_platform"),
    ("first_channel_grouping", "first_channel_grouping"), ("first_traffic_source", "first_traffic_source"),
    ("first_campaign", "first_campaign"), ("user_state", "user_state"),
]
TERM_COLUMNS = [
    ("subscription_id", "subscription_id"), ("subscription_term_id", "subscription_term_id"),
    ("term_number", "term_number"), ("term_started_at", "term_started_at"), ("term_ended_at", "term_ended_at"),
    ("term_active_until", "term_active_until"), ("term_status", "term_status"),
    ("termination_type", "termination_type"), ("is_new_start", "is_new_start"), ("is_paid", "term_is_paid"),
    ("paid_at", "term_paid_at"), ("is_delinquent", "is_delinquent"),
    ("is_failed_payment_canceled", "is_failed_payment_canceled"), ("is_refunded", "is_refunded"),
    ("refunded_at", "refunded_at"), ("cancel_requested_at", "cancel_requested_at"),
    ("cancel_reason", "cancel_reason"),
]
PLAN_TERM_COLUMNS = [
    ("subscription_id", "subscription_id"), ("subscription_term_id", "subscription_term_id"),
    ("subscription_plan_term_id", "subscription_plan_term_id"), ("term_number", "term_number"),
    ("plan_term_number", "plan_term_number"), ("term_started_at", "term_started_at"),
    ("term_ended_at", "term_ended_at"), ("term_status", "term_status"),
    ("plan_term_started_at", "plan_term_started_at"), ("plan_term_ended_at", "plan_term_ended_at"),
    ("plan_term_status", "plan_term_status"), ("is_latest_plan_term", "is_latest_plan_term"), ("plan_id", "plan_id"),
    ("previous_plan_id", "previous_plan_id"), ("plan_name", "plan_name"), ("plan_variant", "plan_variant"),
    ("term_months", "term_months"), ("drug_id", "drug_id"), ("drug_name", "drug_name"),
    ("drug_strength", "drug_strength"), ("regimen", "regimen"), ("monthly_dose", "monthly_dose"),
    ("starting_fulfillment_type", "starting_fulfillment_type"),
]
CHARGE_COLUMNS = [
    ("charge_id", "charge_id"), ("invoice_id", "invoice_id"), ("subscription_id", "subscription_id"),
    ("occurred_at", "occurred_at"), ("attempt_number", "attempt_number"),
    ("attempts_remaining", "attempts_remaining"), ("is_latest_charge", "is_latest_charge"),
    ("amount_due", "amount_due"), ("gross_revenue", "gross_revenue"), ("net_revenue", "net_revenue"),
    ("is_paid", "is_paid"), ("is_failed", "is_failed"), ("was_paid", "was_paid"), ("is_refunded", "is_refunded"),
    ("refunded_at", "refunded_at"), ("failure_reason", "failure_reason"), ("card_brand", "card_brand"),
    ("event_name", "event_name"),
]
INVOICE_COLUMNS = [
    ("subscription_id", "subscription_id"), ("subscription_term_id", "subscription_term_id"),
    ("subscription_plan_term_id", "subscription_plan_term_id"), ("invoice_id", "invoice_id"),
    ("invoice_number", "invoice_number"), ("term_number", "term_number"), ("invoice_status", "invoice_status"),
    ("created_at", "created_at"), ("paid_at", "paid_at"), ("failed_at", "failed_at"),
    ("first_charge_at", "first_charge_at"), ("latest_charge_at", "latest_charge_at"), ("refunded_at", "refunded_at"),
    ("num_charges", "num_charges"), ("amount_due", "amount_due"), ("gross_revenue", "gross_revenue"),
    ("net_revenue", "net_revenue"), ("is_paid", "is_paid"), ("is_failed", "is_failed"),
    ("is_refunded", "is_refunded"), ("is_delinquent", "is_delinquent"),
    ("caused_cancellation", "caused_cancellation"), ("is_latest_term_invoice", "is_latest_term_invoice"),
    ("visit_id", "visit_id"), ("prescription_id", "prescription_id"), ("plan_id", "plan_id"), ("drug_id", "drug_id"),
    ("drug_name", "drug_name"), ("term_started_at", "term_started_at"), ("term_ended_at", "term_ended_at"),
    ("cancel_requested_at", "cancel_requested_at"), ("next_invoice_number", "next_invoice_number"),
    ("next_invoice_status", "next_invoice_status"),
]
EVENT_COLUMNS = [
    ("event_id", "event_id"), ("event_name", "event_name"), ("subscription_id", "subscription_id"),
    ("common_id", "common_id"), ("raw_occurred_at", "raw_occurred_at"), ("occurred_at", "occurred_at"),
    ("old_renewal_at", "old_renewal_at"), ("new_renewal_at", "new_renewal_at"),
    ("current_term_end_at", "current_term_end_at"), ("subscription_created_at", "subscription_created_at"),
    ("changed_by", "changed_by"), ("reason", "reason"), ("state", "state"), ("raw_state", "raw_state"),
    ("termination_type", "termination_type"), ("condition_id", "condition_id"), ("condition_name", "condition_name"),
    ("drug_id", "drug_id"), ("drug_name", "drug_name"), ("drug_strength", "drug_strength"),
    ("monthly_dose", "monthly_dose"), ("plan_id", "plan_id"), ("plan_name", "plan_name"),
    ("new_plan_id", "new_plan_id"), ("old_plan_id", "old_plan_id"), ("amount_due", "amount_due"),
    ("attempt_number", "attempt_number"), ("is_succeeded", "is_succeeded"), ("is_failed", "is_failed"),
    ("is_charge", "is_charge"), ("is_refund", "is_refund"), ("failure_reason", "failure_reason"),
    ("cancel_at_current_term_end", "cancel_at_current_term_end"), ("invoice_id", "invoice_id"),
    ("order_id", "order_id"),
]


def _projection(columns: list[tuple[str, str]]):
    return [F.col(source).alias(name) for source, name in columns]


def conform_plan_types(plan_types: DataFrame, condition: str) -> DataFrame:
    return plan_types.filter(F.col("condition_name") == condition)


def conform_subscriptions(subscriptions: DataFrame, cohort: DataFrame) -> DataFrame:
    return restrict_to(subscriptions, cohort).select(_projection(SUBSCRIPTION_COLUMNS))


def with_cancel_before_cutoff(terms: DataFrame, cal: Calendar) -> DataFrame:
    """Whether the cancel came by the label cutoff; a missing cancel is FALSE, not null."""
    cancelled = F.coalesce(F.col("cancel_requested_at") < day(cal.cancel_flag_cutoff), F.lit(False))
    return terms.withColumns(
        {
            "is_cancelled_before_cutoff": cancelled,
            "cancel_status_before_cutoff": F.when(cancelled, "cancelled").otherwise("not_cancelled"),
        }
    )


def conform_terms(terms: DataFrame, cohort: DataFrame, cal: Calendar) -> DataFrame:
    """All terms of the cohort's subscriptions, reactivated ones included."""
    rows = restrict_to(terms, cohort).select(_projection(TERM_COLUMNS))
    length = days_between("term_started_at", "term_ended_at")
    return with_cancel_before_cutoff(rows.withColumn("days_between_term_start_and_end", length), cal)


def conform_plan_terms(plan_terms: DataFrame, cohort: DataFrame) -> DataFrame:
    return restrict_to(plan_terms, cohort).select(_projection(PLAN_TERM_COLUMNS))


def conform_charges(charges: DataFrame, cohort: DataFrame) -> DataFrame:
    return restrict_to(charges, cohort, hashed=True).select(_projection(CHARGE_COLUMNS))


def conform_invoices(invoices: DataFrame, plan_types: DataFrame, cohort: DataFrame) -> DataFrame:
    """Invoices of the cohort's own terms, with the date the next fill falls due.

    The catalogue is a small reference table; Catalyst broadcasts it when its size allows and falls
    back to a shuffle join otherwise.
    """
    months = plan_types.select("plan_id", F.col("term_months").alias("_months"))
    due = F.timestamp_add("DAY", F.col("_months") * 30, F.col("created_at"))
    return (
        restrict_to(invoices, cohort, TERM, hashed=True)
        .join(months, "plan_id", "left")
        .select(*_projection(INVOICE_COLUMNS), due.alias("expected_refill_dt"))
    )


def conform_events(events: DataFrame, cohort: DataFrame) -> DataFrame:
    return restrict_to(events, cohort).select(_projection(EVENT_COLUMNS))
