"""Checks of the integrity analyses."""

from oracles import oracle, pct, share

_SIZE = "SELECT count(*) AS total_terms, count(DISTINCT subscription_id) AS unique_subscriptions FROM "
oracle("q00_1_cohort_size", _SIZE + "qualified")
oracle("q00_2_several_qualified_terms", """SELECT subscription_id, count(DISTINCT subscription_term_id) AS unique_terms
    FROM qualified GROUP BY subscription_id HAVING unique_terms > 1""")
oracle("q00_3_terms_of_one_subscription", "SELECT * FROM all_terms WHERE subscription_id = 1")
oracle("q00_4_timeline_of_one_subscription", """SELECT raw_occurred_at, occurred_at, event_name, old_renewal_at, new_renewal_at
    FROM cohort_events WHERE subscription_id = 1""")
oracle("q00_5_cohort_against_all_terms", """
    SELECT count(DISTINCT q.subscription_term_id) AS n_terms_in_qualified,
           count(DISTINCT t.subscription_term_id) AS n_terms_in_all_terms
    FROM qualified q JOIN all_terms t ON q.subscription_id = t.subscription_id AND t.term_number = 1""")
oracle("q00_6_several_first_terms", """SELECT subscription_id, count(DISTINCT subscription_term_id) AS n_first_term
    FROM all_terms WHERE term_number = 1 GROUP BY subscription_id HAVING n_first_term > 1""")
oracle("q00_7_refined_cohort_size", _SIZE + "refined")
oracle("q00_8_cancel_status_share", share("refined_flagged", "cancel_status_before_cutoff", places=2))
oracle("q00_9_cancel_status_by_term_status", """SELECT cancel_status_before_cutoff, term_status, count(*) AS n
    FROM refined_flagged GROUP BY ALL""")
oracle("q00_10_cancelled_not_ended", """SELECT count(DISTINCT subscription_id) AS n_not_ended_yet FROM refined_flagged
    WHERE is_cancelled_before_cutoff AND term_status = 'active' AND term_ended_at IS NULL""")
oracle("q00_11_cancelled_active_but_ended", """SELECT subscription_id, subscription_term_id, term_number, term_started_at,
    term_ended_at, cancel_requested_at FROM refined_flagged
    WHERE is_cancelled_before_cutoff AND term_status = 'active' AND term_ended_at IS NOT NULL""")
oracle("q00_12_starts_per_month", """SELECT CAST(date_trunc('month', term_started_at) AS DATE) AS term_start_month, count(*) AS n
    FROM refined_cohort GROUP BY 1""")
oracle("q00_13_cancels_per_week", """SELECT CAST(date_trunc('week', cancel_requested_at) AS DATE) AS cancel_week, count(*) AS n
    FROM refined_flagged WHERE is_cancelled_before_cutoff GROUP BY 1""")
oracle("q00_14_duplicate_terms", "SELECT count(*) AS total_rows, count(DISTINCT subscription_term_id) AS unique_terms FROM refined")
oracle("q00_15_labelled_overall", """
    SELECT count(DISTINCT r.subscription_term_id) AS cohort_size,
           count(DISTINCT t.subscription_term_id) FILTER (WHERE t.is_cancelled_before_cutoff IS NOT NULL) AS labeled,
           cohort_size - labeled AS missing_labels
    FROM refined r LEFT JOIN all_terms t USING (subscription_term_id)""")
oracle("q00_16_labelled_30_days", """
    SELECT count(r.subscription_term_id) AS cohort_size, count(l.subscription_term_id) AS labeled,
           cohort_size - labeled AS missing_labels
    FROM refined r LEFT JOIN labels l ON l.subscription_term_id = r.subscription_term_id""")
oracle("q00_17_several_latest_plans", """SELECT subscription_id, count(DISTINCT subscription_term_id) AS n_latest_terms
    FROM cohort_plan_terms WHERE is_latest_plan_term GROUP BY subscription_id HAVING n_latest_terms > 1""")
oracle("q00_17_latest_plans_per_term", """SELECT 'terms_with_several_latest_plans' AS check_name, count(*) AS n_bad
    FROM (SELECT subscription_term_id FROM latest GROUP BY 1 HAVING count(*) > 1) x""")
oracle("q00_18_plans_of_one_subscription", """SELECT subscription_id, subscription_term_id, subscription_plan_term_id,
    term_number, is_latest_plan_term FROM cohort_plan_terms WHERE subscription_id = 1""")
oracle("q00_19_plans_of_fell_out", """SELECT p.subscription_id, subscription_term_id, subscription_plan_term_id, plan_term_number,
    drug_name, term_months FROM subscription_plan_terms p JOIN subscriptions_core s
    ON s.subscription_id = p.subscription_id AND NOT s.is_activated""")


def _zero_checks(table, checks):
    return " UNION ALL ".join(
        f"SELECT '{name}' AS check_name, count(*) AS n_bad FROM {table} WHERE {bad}" for name, bad in checks.items()
    )


oracle("q00_20_to_25_label_checks", _zero_checks("labels", {
    "bad_day_1": "day_1_after_start - term_started_at <> 1",
    "bad_day_30": "day_30_after_start - term_started_at <> 30",
    "misclassified_cancelled": "cancel_status = 'cancelled_in_30_days' AND cancel_requested_at - term_started_at NOT BETWEEN 1 AND 30",
    "misclassified_at_start": "cancel_status = 'cancelled_at_start' AND cancel_requested_at <> term_started_at",
    "window_exceeds_pull_date": "day_30_after_start > DATE '2001-07-31'",
    "day_1_exceeds_cutoff": "day_1_after_start > DATE '2001-07-02'",
}))
oracle("q00_26_sample_cancelled", """SELECT cancel_status, term_started_at, day_1_after_start, day_30_after_start, cancel_requested_at
    FROM labels WHERE cancel_status <> 'not_cancelled' ORDER BY term_started_at, cancel_requested_at, cancel_status LIMIT 10""")
oracle("q00_27_snapshot_duplicates", """
    SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS unique_sub_snapshot_pairs, total_rows - unique_sub_snapshot_pairs AS duplicates
    FROM (SELECT subscription_id, snapshot_date, count(*) AS n FROM snapshots GROUP BY ALL) p""")
oracle("q00_28_to_33_snapshot_checks", _zero_checks("snapshots", {
    "non_weekly_snapshots": "(snapshot_date - term_started_at) % 7 <> 0",
    "snapshot_on_or_after_cancel": "snapshot_date >= cancel_requested_at",
    "involuntary_window_past_end": "cancel_requested_at IS NULL AND term_ended_at <= DATE '2001-07-31' AND snapshot_date + 30 > term_ended_at",
    "retained_window_past_cutoff": "cancel_requested_at IS NULL AND coalesce(term_ended_at > DATE '2001-07-31', TRUE) AND snapshot_date + 30 > DATE '2001-07-31'",
    "misclassified_label_1": "label = 1 AND coalesce(cancel_requested_at - snapshot_date NOT BETWEEN 1 AND 30, TRUE)",
    "misclassified_label_0": "label = 0 AND cancel_requested_at - snapshot_date BETWEEN 1 AND 30",
}))
oracle("q00_34_label_rate_by_week", f"""SELECT week_number, n AS n_snapshots, k AS n_label_1, {pct('k', 'n')} AS label_rate_pct
    FROM (SELECT week_number, count(*) AS n, CAST(sum(label) AS BIGINT) AS k FROM snapshots GROUP BY 1) w""")
oracle("q00_35_involuntary_stop_rule", """
    SELECT 'involuntary_snapshot_on_or_after_term_end' AS check_name, count(*) AS n_bad
    FROM snapshots s JOIN subscription_terms t USING (subscription_term_id)
    WHERE t.cancel_requested_at IS NULL AND CAST(t.term_ended_at AS DATE) <= DATE '2001-07-31'
      AND s.snapshot_date + 30 > CAST(t.term_ended_at AS DATE)""")
oracle("q00_36_subscriber_types", """
    SELECT CASE WHEN cancel_requested_at IS NULL AND term_ended_at IS NULL THEN 'retained'
                WHEN cancel_requested_at IS NULL THEN 'involuntary_churner' ELSE 'voluntary_churner' END AS subscriber_type,
           count(DISTINCT subscription_id) AS n_subscribers, count(*) AS n_snapshots, CAST(sum(label) AS BIGINT) AS n_label_1
    FROM snapshots GROUP BY 1""")
