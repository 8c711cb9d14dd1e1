"""Column types of the nine landed tables. Columns not listed stay strings."""

from __future__ import annotations

_TIME, _INT, _MONEY, _BOOL = "timestamp", "integer", "decimal(18,2)", "boolean"

# Table and column names as delivered by the source system.
_TYPED_COLUMNS = {
    "subscriptions": {
        "created_at": _TIME, "current_term_end": _TIME, "latest_delinquent_at": _TIME, "latest_canceled_at": _TIME,
        "latest_paused_at": _TIME, "activated_backend_at": _TIME, "paid_at": _TIME, "rx_written_at": _TIME,
        "activated_at": _TIME, "trial_converted_at": _TIME, "trial_ended_at": _TIME, "trial_conversion_expected_at":
        _TIME, "_kafka_updated_ts": _TIME, "_updated_ts": _TIME,
        "condition_id": _INT, "trial_duration": _INT, "current_drug_id": _INT, "current_quantity": _INT,
        "current_days_supply": _INT, "desired_refill_count": _INT, "user_subscription_number": _INT,
        "current_price": _MONEY,
        "had_trial": _BOOL, "is_paid": _BOOL, "rx_is_written": _BOOL, "is_activated_backend": _BOOL,
        "is_trial_converted": _BOOL, "trial_is_ended": _BOOL, "is_manual_trial_canceled": _BOOL,
        "is_failed_payment_trial_canceled": _BOOL, "is_trial_canceled": _BOOL, "is_activated": _BOOL,
    },
    "subscription_terms": {
        "_sub_activated_at": _TIME, "term_started_at": _TIME, "next_term_started_at": _TIME, "term_ended_at": _TIME,
        "term_active_until": _TIME, "trial_converted_at": _TIME, "trial_ended_at": _TIME,
        "trial_conversion_expected_at": _TIME, "cancel_requested_at": _TIME, "cancel_expected_at": _TIME, "paid_at":
        _TIME, "refunded_at": _TIME, "_updated_ts": _TIME,
        "condition_id": _INT, "term_number": _INT,
        "is_new_start": _BOOL, "had_trial": _BOOL, "is_trial_converted": _BOOL, "trial_is_ended": _BOOL,
        "is_trial_canceled": _BOOL, "is_manual_trial_canceled": _BOOL, "is_failed_payment_trial_canceled": _BOOL,
        "is_paid": _BOOL, "is_delinquent": _BOOL, "is_failed_payment_canceled": _BOOL, "trial_is_delinquent": _BOOL,
        "is_refunded": _BOOL,
    },
    "subscription_plan_terms": {
        "term_started_at": _TIME, "term_ended_at": _TIME, "plan_term_started_at": _TIME, "plan_term_ended_at": _TIME,
        "next_plan_term_started_at": _TIME,
        "condition_id": _INT, "term_number": _INT, "plan_term_number": _INT, "drug_id": _INT, "monthly_dose": _INT,
        "term_months": _INT,
        "is_latest_plan_term": _BOOL,
    },
    "subscription_plan_types": {
        "created_at": _TIME, "updated_at": _TIME, "_fivetran_synced": _TIME,
        "condition_id": _INT, "drug_id": _INT, "monthly_dose": _INT, "quantity_per_fill": _INT,
        "desired_refill_count": _INT, "billing_duration_count": _INT, "days_supply_per_fill": _INT, "term_months":
        _INT,
        "prescription_price": _MONEY, "billing_price": _MONEY, "term_price": _MONEY,
        "_fivetran_deleted": _BOOL,
    },
    "subscription_charges": {
        "occurred_at": _TIME, "current_term_end_at": _TIME, "refunded_at": _TIME,
        "condition_id": _INT, "drug_id": _INT, "attempt_number": _INT, "activation_count": _INT,
        "amount_due": _MONEY, "gross_revenue": _MONEY, "net_revenue": _MONEY,
        "is_latest_charge": _BOOL, "is_refunded": _BOOL, "is_failed": _BOOL, "was_paid": _BOOL, "is_paid": _BOOL,
    },
    "subscription_invoices": {
        "created_at": _TIME, "paid_at": _TIME, "failed_at": _TIME, "first_charge_at": _TIME, "refunded_at": _TIME,
        "latest_charge_at": _TIME, "latest_term_end_at": _TIME, "term_started_at": _TIME, "term_ended_at": _TIME,
        "plan_term_started_at": _TIME, "plan_term_ended_at": _TIME, "order_updated_at": _TIME, "cancel_requested_at":
        _TIME, "next_invoice_created_at": _TIME, "expected_refill_dt": _TIME,
        "invoice_number": _INT, "activation_count": _INT, "num_charges": _INT, "term_number": _INT, "drug_id": _INT,
        "next_invoice_number": _INT, "days_between_invoice_and_fulfillment_status": _INT,
        "amount_due": _MONEY, "gross_revenue": _MONEY, "net_revenue": _MONEY,
        "was_paid": _BOOL, "was_failed": _BOOL, "is_paid": _BOOL, "is_failed": _BOOL, "is_refunded": _BOOL,
        "is_delinquent": _BOOL, "caused_cancellation": _BOOL, "is_trial_invoice": _BOOL,
        "is_trial_conversion_invoice": _BOOL, "is_latest_term_invoice": _BOOL, "is_dup": _BOOL,
        "next_invoice_creation_is_expected": _BOOL,
    },
    "subscriptions_churn": {
        "term_started_at": _TIME, "term_ended_at": _TIME, "cancel_requested_at": _TIME, "forecasted_churn_date":
        _TIME, "first_invoice_paid_dt": _TIME, "last_invoice_paid_dt": _TIME,
        "term_number": _INT, "term_months": _INT, "count_paid_invoices": _INT,
        "total_paid_amount": _MONEY, "net_paid_amount": _MONEY,
        "is_reactivated_term": _BOOL, "is_activated": _BOOL,
    },
    "subscription_orders": {
        "status_updated_at": _TIME, "created_at": _TIME, "in_triage_at": _TIME, "in_transit_at": _TIME, "canceled_at":
        _TIME, "eta_first_updated_at": _TIME, "eta_latest_updated_at": _TIME, "completed_at": _TIME, "confirmed_at":
        _TIME,
    },
    "int_subs_kafka__events": {
        "raw_occurred_at": _TIME, "occurred_at": _TIME, "old_renewal_at": _TIME, "new_renewal_at": _TIME,
        "subscription_created_at": _TIME, "current_term_end_at": _TIME,
        "condition_id": _INT, "drug_id": _INT, "monthly_dose": _INT, "attempt_number": _INT, "trial_duration_days":
        _INT,
        "amount_due": _MONEY,
        "is_refund": _BOOL, "is_failed": _BOOL, "is_succeeded": _BOOL, "is_charge": _BOOL, "is_trial_end_event":
        _BOOL, "is_first_post_trial_payment": _BOOL, "canceled_during_trial": _BOOL, "cancel_at_current_term_end":
        _BOOL,
    },
}

SOURCE_TABLES = list(_TYPED_COLUMNS)


def casts_for(table: str) -> dict[str, str]:
    """``{column: type}`` for one landed table."""
    return dict(_TYPED_COLUMNS[table])
