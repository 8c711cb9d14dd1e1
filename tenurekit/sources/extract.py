"""Which rows of each source table belong to the studied condition.

Plain predicates on scans, so equality and list filters are pushed into the file reader. A lowered
comparison is evaluated after the scan; store a lowered column where that matters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The event names the study extracts, and the prefix of a churn row's product name.
EXTRACTED_EVENTS = [
    "upcoming_term_renewal_notified",
    "term_renewal_time_changed",
    "condition_subscription_prescription_written",
    "cancellation_intent_declared",
    "condition_subscription_new_prescription_required",
    "plan_change_requested",
    "clinician_plan_approved",
    "order_fulfillment_confirmed",
    "canceled",
    "cancellation_intent_revoked",
]
CHURN_NAME_PREFIX = "conditions: "


def by_exact_condition(df: DataFrame, condition: str, column: str = "condition_name") -> DataFrame:
    """Case-sensitive match, as subscriptions are extracted."""
    return df.filter(F.col(column) == condition)


def by_condition(df: DataFrame, condition: str, column: str = "condition_name") -> DataFrame:
    """Case-blind match: terms, plan terms and charges; invoices on their sub-category."""
    return df.filter(F.lower(column) == condition.lower())


def invoices_of(df: DataFrame, condition: str) -> DataFrame:
    return by_condition(df, condition, "subscription_subcategory")


def churn_rows_of(df: DataFrame, condition: str) -> DataFrame:
    return by_condition(df, CHURN_NAME_PREFIX + condition, "subscription_name")


def plan_types_of(df: DataFrame) -> DataFrame:
    """The catalogue is taken whole."""
    return df


def events_of(df: DataFrame, condition: str) -> DataFrame:
    return by_condition(df, condition).filter(F.col("event_name").isin(EXTRACTED_EVENTS))


def orders_of(orders: DataFrame, invoices: DataFrame, condition: str, how: str = "inner") -> DataFrame:
    """Orders behind the condition's invoices.

    ``inner`` repeats an order for each invoice that names it; ``left_semi`` gives it once.
    """
    named = invoices_of(invoices, condition).select(F.col("latest_order_id").alias("order_id"))
    return orders.join(named.distinct() if how == "left_semi" else named, "order_id", how)
