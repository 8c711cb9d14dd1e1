"""Checks of the first-30-day rates and their tests."""

from oracles import block, chi2_test, oracle, rates, share
from oracles.groups import CHANNEL_GROUP, DOSE_GROUP_OR_ITSELF, STRENGTH_GROUP_OR_ITSELF

oracle("q04_1_refined_cohort_size", "SELECT count(*) AS total_terms, count(DISTINCT subscription_id) AS unique_subscriptions FROM refined")
oracle("q04_2_labels_refined", """SELECT subscription_id, subscription_term_id, term_started_at, cancel_requested_at, cancel_status,
    is_cancelled FROM labels_refined""")
oracle("q04_3_labelled_size", "SELECT count(*) AS total_terms, count(DISTINCT subscription_id) AS unique_subscriptions FROM labels_refined")
oracle("q04_4_status_share", share("labels_refined", "cancel_status", places=2))

block("risk_plan", """SELECT l.subscription_id, l.cancel_status, p.* EXCLUDE (subscription_id) FROM labels_refined l JOIN latest p
    ON p.subscription_term_id = l.subscription_term_id WHERE l.cancel_status <> 'cancelled_at_start'""")
block("risk_person", """SELECT l.subscription_id, l.cancel_status, s.* EXCLUDE (subscription_id) FROM labels_refined l JOIN subscriptions s
    ON s.subscription_id = l.subscription_id WHERE l.cancel_status <> 'cancelled_at_start'""")
_HIT = "cancel_status = 'cancelled_in_30_days'"


def _tested(source, by, having=""):
    table = f"SELECT n_subscribers AS n, n_cancelled AS k FROM ({rates(source, by, _HIT, having=having)}) r"
    return f"SELECT round(chi2, 6) AS chi2, dof, p_value, p_value < 0.05 AS significant FROM ({chi2_test(table)}) c"


for _name, _source, _by in (
    ("q04_5_rate_by_cadence", "risk_plan", "term_months AS cadence"),
    ("q04_6_rate_by_drug", "risk_plan", "drug_name"),
    ("q04_7_rate_by_drug_and_regimen", "risk_plan", "drug_name;regimen"),
    ("q04_8_rate_by_regimen", "risk_plan", "regimen"),
    ("q04_9_rate_by_strength", "risk_plan", "drug_strength"),
    ("q04_10_rate_by_strength_group", "risk_plan", STRENGTH_GROUP_OR_ITSELF),
    ("q04_11_rate_by_monthly_dose", "risk_plan", "monthly_dose"),
    ("q04_12_rate_by_dose_group", "risk_plan", DOSE_GROUP_OR_ITSELF),
    ("q04_15_rate_by_channel", "risk_person", "first_channel_grouping"),
    ("q04_16_rate_by_channel_group", "risk_person", CHANNEL_GROUP),
    ("q04_17_rate_by_platform", "risk_person", "first_platform"),
    ("q04_18_rate_by_state", "risk_person", "user_state"),
):
    _having = "WHERE _n >= 100" if _by == "user_state" else ""
    oracle(_name, rates(_source, _by, _HIT, having=_having))
    if ";" not in _by:
        oracle(f"{_name}_chi2", _tested(_source, _by, _having))
oracle("q04_7_rate_by_drug_as_needed_chi2", _tested("(SELECT * FROM risk_plan WHERE regimen = 'AS_NEEDED') a", "drug_name"))
oracle("q04_13_fulfillment_methods", "SELECT fulfillment_method FROM plan_types GROUP BY ALL")
block("failed_history", """
    SELECT l.subscription_term_id, count(*) FILTER (WHERE i.is_failed) AS failed_invoice_count
    FROM cohort_invoices i JOIN labels_refined l ON l.subscription_term_id = i.subscription_term_id
    WHERE i.created_at <= l.term_started_at AND coalesce(i.failed_at, i.created_at) <= l.term_started_at GROUP BY 1""")
oracle("ft13_failed_invoices_at_start", "SELECT * FROM failed_history")
oracle("q04_14_rate_by_failed_invoices", rates(
    """(SELECT l.subscription_id, l.cancel_status, h.failed_invoice_count FROM labels_refined l JOIN failed_history h
        ON h.subscription_term_id = l.subscription_term_id WHERE l.cancel_status <> 'cancelled_at_start') r""",
    "failed_invoice_count", _HIT))
