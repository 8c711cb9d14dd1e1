"""Checks of the cohort overview."""

from oracles import oracle, share

oracle("q01_1_refined_cohort_size", "SELECT count(*) AS total_terms, count(DISTINCT subscription_id) AS unique_subscriptions FROM refined")
oracle("q01_2_starts_per_month", """SELECT CAST(date_trunc('month', term_started_at) AS DATE) AS term_start_month, count(*) AS n
    FROM refined_cohort GROUP BY 1""")
for _name in ("q01_3_cancel_status_share_ordered", "q01_5_cancel_status_share"):
    oracle(_name, share("refined_flagged", "cancel_status_before_cutoff", places=2))
oracle("q01_4_cancels_per_month", """SELECT CAST(date_trunc('month', cancel_requested_at) AS DATE) AS cancel_month, count(*) AS n
    FROM refined_flagged WHERE is_cancelled_before_cutoff GROUP BY 1""")
oracle("q01_6_start_label_share", share(
    "refined r LEFT JOIN labels l ON l.subscription_term_id = r.subscription_term_id", "cancel_status", places=2))
_SUBS = "count(DISTINCT r.subscription_id)"
for _name, _by in (
    ("q01_7_share_by_drug", "drug_name"),
    ("q01_8_share_by_strength", "drug_strength"),
    ("q01_9_share_by_regimen", "regimen"),
    ("q01_10_share_by_cadence", "term_months AS cadence"),
):
    oracle(_name, share("refined r JOIN latest p ON p.subscription_term_id = r.subscription_term_id", _by, n=_SUBS,
                        names=("n_subscriptions", "pct")))
oracle("q01_11_share_by_state", share(
    "refined r JOIN subscriptions s ON s.subscription_id = r.subscription_id", "user_state", n=_SUBS,
    names=("n_subscriptions", "pct")))
