"""Reporting columns of the conformed tables, as SQL select lists. Money is compared as DOUBLE."""

SUBSCRIPTION_COLUMNS = """
    subscription_id, common_id, activated_at AS subs_activated_at, status, is_paid AS subs_is_paid,
    is_activated AS subs_is_activated, latest_canceled_at AS subs_latest_canceled_at,
    latest_paused_at AS subs_latest_paused_at, user_subscription_number, first_platform, first_channel_grouping,
    first_traffic_source, first_campaign, user_state
"""
TERM_COLUMNS = """
    subscription_id, subscription_term_id, term_number, term_started_at, term_ended_at, term_active_until,
    term_status, termination_type, is_new_start, is_paid AS term_is_paid, paid_at AS term_paid_at, is_delinquent,
    is_failed_payment_canceled, is_refunded, refunded_at, cancel_requested_at, cancel_reason
"""
PLAN_TERM_COLUMNS = """
    subscription_id, subscription_term_id, subscription_plan_term_id, term_number, plan_term_number, term_started_at,
    term_ended_at, term_status, plan_term_started_at, plan_term_ended_at, plan_term_status, is_latest_plan_term,
    plan_id, previous_plan_id, plan_name, plan_variant, term_months, drug_id, drug_name, drug_strength, regimen,
    monthly_dose, starting_fulfillment_type
"""
CHARGE_COLUMNS = """
    charge_id, invoice_id, subscription_id, occurred_at, attempt_number, attempts_remaining, is_latest_charge,
    CAST(amount_due AS DOUBLE) AS amount_due, CAST(gross_revenue AS DOUBLE) AS gross_revenue, CAST(net_revenue AS DOUBLE) AS net_revenue, is_paid, is_failed, was_paid, is_refunded, refunded_at, failure_reason,
    card_brand, event_name
"""
INVOICE_COLUMNS = """
    subscription_id, subscription_term_id, subscription_plan_term_id, invoice_id, invoice_number, term_number,
    invoice_status, created_at, paid_at, failed_at, first_charge_at, latest_charge_at, refunded_at, num_charges,
    CAST(amount_due AS DOUBLE) AS amount_due, CAST(gross_revenue AS DOUBLE) AS gross_revenue, CAST(net_revenue AS DOUBLE) AS net_revenue, is_paid, is_failed, is_refunded, is_delinquent, caused_cancellation,
    is_latest_term_invoice, visit_id, prescription_id, plan_id, drug_id, drug_name, term_started_at, term_ended_at,
    cancel_requested_at, next_invoice_number, next_invoice_status
"""
EVENT_COLUMNS = """
    event_id, event_name, subscription_id, common_id, raw_occurred_at, occurred_at, old_renewal_at, new_renewal_at,
    current_term_end_at, subscription_created_at, changed_by, reason, state, raw_state, termination_type,
    condition_id, condition_name, drug_id, drug_name, drug_strength, monthly_dose, plan_id, plan_name, new_plan_id,
    old_plan_id, CAST(amount_due AS DOUBLE) AS amount_due, attempt_number, is_succeeded, is_failed, is_charge, is_refund, failure_reason,
    cancel_at_current_term_end, invoice_id, order_id
"""
