"""Checks of the cancellation-type analyses."""

from oracles import block, half_up, oracle, share
from oracles.groups import DOSE_GROUP, STRENGTH_GROUP

oracle("q03_1_refined_cohort_size", "SELECT count(*) AS total_terms, count(DISTINCT subscription_id) AS unique_subscriptions FROM refined")
oracle("q03_2_cancellation_type", """SELECT subscription_id, subscription_term_id, term_started_at, term_ended_at,
    cancel_requested_at, cancellation_type FROM typed""")
_SUBS = "count(DISTINCT subscription_id)"
oracle("q03_3_type_share", share("typed", "cancellation_type", n=_SUBS))
oracle("q03_4_failed_payment_flags", "SELECT is_failed_payment_canceled FROM subscription_terms GROUP BY ALL")
for _name in ("q03_5_failed_charges_by_attempt_first_copy", "q03_7_failed_charges_by_attempt"):
    oracle(_name, """SELECT attempt_number, attempts_remaining, count(DISTINCT c.subscription_id) AS n_subs
        FROM cohort_charges c JOIN typed t ON t.subscription_id = c.subscription_id WHERE NOT c.was_paid GROUP BY ALL""")
oracle("q03_6_null_flag_by_termination_type", """SELECT is_failed_payment_canceled, termination_type, count(DISTINCT subscription_id) AS n_subs
    FROM typed WHERE is_failed_payment_canceled IS NULL GROUP BY ALL""")
block("involuntary", "SELECT * FROM typed WHERE cancellation_type = 'involuntary_cancellation'")
block("cancelled_by", """SELECT i.*, e.changed_by FROM involuntary i LEFT JOIN cohort_events e
    ON e.subscription_id = i.subscription_id AND e.event_name = 'canceled'""")
oracle("q03_8_all_attempts_failed", """SELECT is_failed_payment_canceled, termination_type, changed_by, count(DISTINCT subscription_id) AS n_subs
    FROM cancelled_by WHERE subscription_id IN (SELECT subscription_id FROM cohort_charges WHERE attempt_number = 8 AND NOT was_paid)
    GROUP BY ALL""")
oracle("q03_9_involuntary_by_flag", share("involuntary", "is_failed_payment_canceled", n=_SUBS, names=("n_subs", "pct")))
oracle("q03_10_involuntary_by_flag_and_termination", share(
    "involuntary", "is_failed_payment_canceled;termination_type", n=_SUBS, names=("n_subs", "pct")))
oracle("q03_11_involuntary_not_payment_by_canceller", """SELECT termination_type, changed_by, count(DISTINCT subscription_id) AS n_subs
    FROM cancelled_by WHERE is_failed_payment_canceled IS FALSE GROUP BY ALL""")
oracle("q03_12_valid_cohort_size", """SELECT cancellation_type, count(*) AS n_rows, count(DISTINCT subscription_id) AS n_subscriptions
    FROM valid GROUP BY ALL""")
for _name, _by in (
    ("q03_13_type_by_cadence", "term_months AS cadence"),
    ("q03_14_type_by_drug", "drug_name"),
    ("q03_15_type_by_regimen", "regimen"),
    ("q03_16_type_by_strength_group", STRENGTH_GROUP),
    ("q03_17_type_by_dose_group", DOSE_GROUP),
):
    oracle(_name, share("valid v JOIN latest p ON p.subscription_term_id = v.subscription_term_id", f"cancellation_type;{_by}",
                        n="count(DISTINCT v.subscription_id)", within="cancellation_type", names=("n", "pct_within_type")))
oracle("q03_18_payment_behaviour", f"""
    SELECT cancellation_type, {half_up('charges', 'invoices', 2)} AS avg_num_charges, {half_up('failed', 'invoices', 3)} AS avg_failure_rate,
           {half_up('delinquent', 'invoices', 3)} AS avg_delinquency_rate, n
    FROM (SELECT cancellation_type, sum(num_charges) AS charges, count(*) AS invoices, count(*) FILTER (WHERE i.is_failed) AS failed,
                 count(*) FILTER (WHERE i.is_delinquent) AS delinquent, count(DISTINCT v.subscription_id) AS n
          FROM valid v JOIN cohort_invoices i ON i.subscription_term_id = v.subscription_term_id GROUP BY 1) s""")
block("cancel_timing", """SELECT cancellation_type, CAST(coalesce(c, e) - CAST(term_started_at AS DATE) AS INTEGER) AS days_to_cancellation
    FROM valid WHERE cancellation_type <> 'not_cancelled'""")
oracle("q03_19_days_to_cancellation", "SELECT cancellation_type, days_to_cancellation, count(*) AS n FROM cancel_timing GROUP BY ALL")
oracle("st7_days_to_cancellation_histogram", """
    SELECT e.cancellation_type, b.bin, round(lo + b.bin * w, 6) AS bin_start, round(lo + (b.bin + 1) * w, 6) AS bin_end,
           count(days) AS n, round(count(days) / (total * w), 6) AS density
    FROM (SELECT cancellation_type, CAST(min(days_to_cancellation) AS DOUBLE) AS lo, CAST(max(days_to_cancellation) AS DOUBLE) AS hi,
                 (hi - lo) / 60 AS w, count(*) AS total FROM cancel_timing GROUP BY 1) e
    CROSS JOIN (SELECT CAST(unnest(range(0, 60)) AS INTEGER) AS bin) b
    LEFT JOIN (SELECT cancellation_type, days_to_cancellation AS days FROM cancel_timing) d
      ON d.cancellation_type = e.cancellation_type AND b.bin = least(59, CAST(floor((days - lo) * 60 / (hi - lo)) AS INTEGER))
    GROUP BY e.cancellation_type, b.bin, lo, w, total""")
oracle("q03_20_label_by_type", share("valid v JOIN labels l ON l.subscription_term_id = v.subscription_term_id",
                                     "cancel_status;cancellation_type", n="count(DISTINCT l.subscription_id)"))
