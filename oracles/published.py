"""Checks of the result tables that were reported without their queries."""

from oracles import block, oracle, rates

_NAMES = ("count_subscribers", "cnt_cancel_requested_in_30d", "cnt_cancel_pct")
block("cohort_30", """SELECT *, coalesce(CAST(cancel_requested_at AS DATE) - CAST(term_started_at AS DATE) BETWEEN 0 AND 30, FALSE) AS hit
    FROM cohort""")
block("cohort_plan", """SELECT c.subscription_id, c.subscription_term_id, c.hit, c.term_status, p.term_months AS cadence_months,
    p.drug_name AS latest_drug_name, p.drug_strength AS latest_drug_strength
    FROM cohort_30 c JOIN latest p ON p.subscription_term_id = c.subscription_term_id""")


def _rates(source, by):
    return rates(source, by, "hit", names=_NAMES, places=6)


oracle("qr_1_term_status", "SELECT term_status, count(DISTINCT subscription_id) AS count_subscribers FROM cohort GROUP BY 1")
oracle("qr_2_overall_rate", _rates("cohort_30", ""))
oracle("qr_3_rate_by_cadence", _rates("cohort_plan", "cadence_months"))
oracle("qr_4_cadence_by_term_status", f"SELECT * EXCLUDE (cnt_cancel_pct) FROM ({_rates('cohort_plan', 'cadence_months;term_status')}) r")
oracle("qr_5_rate_by_cadence_and_plan_changes", _rates("""(SELECT *, (SELECT count(*) - 1 FROM subscription_plan_terms p
    WHERE p.subscription_term_id = c.subscription_term_id) AS plan_change_count FROM cohort_plan c) x""", "cadence_months;plan_change_count"))
oracle("qr_6_rate_by_cadence_and_refills", _rates("""(SELECT *, greatest((SELECT count(*) FROM subscription_invoices i
    WHERE i.subscription_term_id = c.subscription_term_id AND i.is_paid) - 1, 0) AS refill_count FROM cohort_plan c) x""",
    "cadence_months;refill_count"))
oracle("qr_7_rate_by_latest_drug", _rates("cohort_plan", "latest_drug_name"))
oracle("qr_8_rate_by_latest_drug_and_strength", _rates("cohort_plan", "latest_drug_name;latest_drug_strength"))
block("visits", """SELECT c.subscription_id, c.hit, c.cancel_requested_at IS NOT NULL AS cancelled, count(DISTINCT i.visit_id) AS visit_count
    FROM cohort_30 c JOIN subscription_invoices i ON i.subscription_term_id = c.subscription_term_id
    JOIN subscriptions_core a ON a.subscription_id = c.subscription_id
    WHERE CAST(i.created_at AS DATE) >= CAST(a.activated_at AS DATE)
      AND CAST(i.created_at AS DATE) <= coalesce(CAST(c.cancel_requested_at AS DATE), DATE '9999-12-31')
    GROUP BY c.subscription_id, c.subscription_term_id, c.hit, c.cancel_requested_at""")
oracle("qr_9_cancel_rate_by_visits", rates("visits", "visit_count", "cancelled",
       names=("total_subscribers", "cancelled_subscribers", "cancel_rate_pct"), places=2))
oracle("qr_10_rate_by_visits", rates("visits", "visit_count", "hit",
       names=("total_subscribers", "cancel_requested_in_30d", "cancel_rate_pct"), places=2))
