"""Building blocks for the conformed tables, cohorts, labels and snapshots, and their own checks."""

from oracles import block, oracle
from oracles import columns as listed
from oracles.groups import CHANNEL_GROUP

block("qualified", """
    SELECT DISTINCT subscription_id, subscription_term_id
    FROM subscription_terms JOIN (SELECT subscription_id FROM subscriptions_core WHERE is_paid AND is_activated) ok
    USING (subscription_id) WHERE term_number = 1 AND term_started_at < TIMESTAMP '2001-07-02'""")
block("cohort", "SELECT t.* FROM qualified q JOIN subscription_terms t USING (subscription_term_id)")
block("refined", """
    SELECT * FROM qualified WHERE subscription_id NOT IN (
      SELECT subscription_id FROM subscription_terms WHERE term_number = 1
      GROUP BY subscription_id HAVING count(DISTINCT subscription_term_id) >= 2)""")
block("refined_cohort", "SELECT t.* FROM refined r JOIN subscription_terms t USING (subscription_term_id)")


def _of_cohort(columns, table, key="subscription_id"):
    return f"SELECT {columns} FROM {table} x WHERE EXISTS (FROM qualified q WHERE q.{key} = x.{key})"


_FLAGGED = """*, coalesce(cancel_requested_at < TIMESTAMP '2001-08-01', FALSE) AS is_cancelled_before_cutoff,
    if(coalesce(cancel_requested_at < TIMESTAMP '2001-08-01', FALSE), 'cancelled', 'not_cancelled')
      AS cancel_status_before_cutoff"""
block("all_terms", f"""
    SELECT {_FLAGGED}, CAST(CAST(term_ended_at AS DATE) - CAST(term_started_at AS DATE) AS INTEGER)
      AS days_between_term_start_and_end
    FROM ({_of_cohort(listed.TERM_COLUMNS, 'subscription_terms')}) t""")
block("refined_flagged", f"SELECT {_FLAGGED} FROM refined_cohort")
block("plan_types", "SELECT * FROM subscription_plan_types WHERE condition_name = 'alpha care'")
block("cohort_plan_terms", _of_cohort(listed.PLAN_TERM_COLUMNS, "subscription_plan_terms"))
block("cohort_charges", _of_cohort(listed.CHARGE_COLUMNS, "subscription_charges"))
block("cohort_invoices", f"""
    SELECT i.*, i.created_at + to_days(CAST(p.term_months * 30 AS INTEGER)) AS expected_refill_dt
    FROM ({_of_cohort(listed.INVOICE_COLUMNS, 'subscription_invoices', 'subscription_term_id')}) i
    LEFT JOIN subscription_plan_types p ON p.plan_id = i.plan_id""")
block("cohort_events", _of_cohort(listed.EVENT_COLUMNS, "int_subs_kafka__events"))
block("latest", "SELECT * FROM subscription_plan_terms WHERE is_latest_plan_term")

_LABEL = """
    SELECT subscription_id, subscription_term_id, s AS term_started_at, e AS term_ended_at,
           s + 1 AS day_1_after_start, s + 30 AS day_30_after_start, c AS cancel_requested_at,
           CAST(coalesce(c - s BETWEEN 0 AND 30, FALSE) AS INTEGER) AS is_cancelled,
           CASE WHEN c = s THEN 'cancelled_at_start' WHEN c - s BETWEEN 1 AND 30 THEN 'cancelled_in_30_days'
                ELSE 'not_cancelled' END AS cancel_status
    FROM (SELECT subscription_id, subscription_term_id, CAST(term_started_at AS DATE) AS s,
                 CAST(term_ended_at AS DATE) AS e, CAST(cancel_requested_at AS DATE) AS c
          FROM {cohort}
          WHERE cancel_requested_at IS NOT NULL OR term_ended_at IS NULL
             OR term_ended_at > TIMESTAMP '2001-07-31') d"""
block("labels", _LABEL.format(cohort="cohort"))
block("labels_refined", _LABEL.format(cohort="refined_cohort"))
# The literal form: 53 candidate weeks per term, kept or not by the stop rule that applies.
block("snapshots", """
    SELECT *, CAST(coalesce(cancel_requested_at - snapshot_date BETWEEN 1 AND 30, FALSE) AS INTEGER) AS label
    FROM (
      SELECT d.*, CAST(term_started_at + CAST(7 * w AS INTEGER) AS DATE) AS snapshot_date, CAST(w AS INTEGER) AS week_number,
             CAST(7 * w AS INTEGER) AS days_since_term_start
      FROM (SELECT subscription_id, subscription_term_id, CAST(term_started_at AS DATE) AS term_started_at,
                   CAST(term_ended_at AS DATE) AS term_ended_at,
                   CASE WHEN cancel_requested_at < TIMESTAMP '2001-08-01' THEN CAST(cancel_requested_at AS DATE) END
                     AS cancel_requested_at
            FROM cohort) d, (SELECT unnest(generate_series(0, 52)) AS w) weeks) s
    WHERE CASE WHEN cancel_requested_at IS NOT NULL THEN snapshot_date < cancel_requested_at
               WHEN term_ended_at <= DATE '2001-07-31' THEN snapshot_date + 30 <= term_ended_at
               ELSE snapshot_date + 30 <= DATE '2001-07-31' END""")
block("typed", """
    SELECT *, CASE WHEN c <= DATE '2001-07-31' THEN 'voluntary_cancellation'
                   WHEN c IS NULL AND e <= DATE '2001-07-31' THEN 'involuntary_cancellation'
                   WHEN e IS NULL OR greatest(e, c) > DATE '2001-07-31' THEN 'not_cancelled' END AS cancellation_type
    FROM (SELECT *, CAST(term_ended_at AS DATE) AS e, CAST(cancel_requested_at AS DATE) AS c FROM refined_cohort) d""")
_CLEAR = "(cancel_requested_at IS NOT NULL OR term_ended_at IS NULL OR is_failed_payment_canceled IS NOT FALSE)"
block("valid", f"""
    SELECT t.* FROM typed t JOIN (SELECT subscription_id FROM subscription_terms WHERE {_CLEAR}) k
    ON k.subscription_id = t.subscription_id""")
block("single_plan", """
    SELECT subscription_id, min(term_months) AS term_months FROM subscription_plan_terms
    GROUP BY subscription_id HAVING count(DISTINCT subscription_plan_term_id) = 1""")
block("first_plan", """
    SELECT s.subscription_id, s.is_activated, p.drug_name, p.regimen, p.term_months,
           CAST(p.monthly_dose AS DOUBLE) AS monthly_dose
    FROM subscriptions_core s JOIN subscription_plan_terms p USING (subscription_id)
    WHERE s.is_activated AND p.term_number = 1 AND p.plan_term_number = 1""")
block("wanted_plan", """
    SELECT subscription_id, is_activated, drug_name, current_regimen AS regimen, term_months,
           current_quantity / term_months AS monthly_dose
    FROM (SELECT s.*, t.drug_name, CAST(CASE WHEN current_days_supply IN (30, 32) THEN 1
                   WHEN current_days_supply IN (90, 96) THEN 3
                   WHEN current_days_supply IN (180, 192) THEN 6 END AS INTEGER) AS term_months
          FROM subscriptions_core s JOIN plan_types t ON t.drug_id = s.current_drug_id WHERE NOT s.is_activated) w""")

oracle("ex1_subscriptions", "SELECT subscription_id, condition_name, status FROM subscriptions_core WHERE condition_name = 'alpha care'")
_LIKE = "condition_name ILIKE 'alpha care'"
oracle("ex2_terms", f"SELECT subscription_term_id, subscription_id, condition_name, term_status FROM subscription_terms WHERE {_LIKE}")
oracle("ex3_plan_terms", f"SELECT subscription_plan_term_id, subscription_term_id, condition_name FROM subscription_plan_terms WHERE {_LIKE}")
oracle("ex4_charges", f"SELECT charge_id, invoice_id, subscription_id, attempt_number FROM subscription_charges WHERE {_LIKE}")
oracle("ex5_invoices", "SELECT invoice_id, subscription_term_id, subscription_subcategory FROM subscription_invoices WHERE subscription_subcategory ILIKE 'alpha care'")
oracle("ex6_churn_rows", "SELECT common_id, subscription_term_id, subscription_name, is_reactivated_term FROM subscriptions_churn WHERE subscription_name ILIKE 'conditions: alpha care'")
oracle("ex7_plan_types", "SELECT * FROM subscription_plan_types")
oracle("ex8_events", f"""SELECT event_id, event_name, subscription_id FROM int_subs_kafka__events WHERE {_LIKE}
    AND event_name IN ('upcoming_term_renewal_notified', 'term_renewal_time_changed', 'canceled', 'plan_change_requested',
    'condition_subscription_prescription_written')""")
oracle("ex9_orders_per_invoice", """SELECT o.order_id, o.status FROM subscription_invoices i JOIN subscription_orders o
    ON o.order_id = i.latest_order_id WHERE i.subscription_subcategory ILIKE 'alpha care'""")
oracle("ex9_orders_once", """SELECT order_id, status FROM subscription_orders WHERE order_id IN (
    SELECT latest_order_id FROM subscription_invoices WHERE subscription_subcategory ILIKE 'alpha care')""")

oracle("sv1_qualified_cohort", "SELECT * FROM qualified")
oracle("sv2_plan_types", "SELECT * FROM plan_types")
oracle("sv3_subscriptions", _of_cohort(listed.SUBSCRIPTION_COLUMNS, "subscriptions"))
oracle("sv4_all_terms", "SELECT * FROM all_terms")
oracle("sv5_plan_terms", "SELECT * FROM cohort_plan_terms")
oracle("sv6_charges", "SELECT * FROM cohort_charges")
oracle("sv7_invoices", "SELECT * FROM cohort_invoices")
oracle("sv8_events", "SELECT * FROM cohort_events")
oracle("sv9_start_labels", "SELECT * FROM labels")
oracle("sv10_weekly_snapshots", "SELECT * FROM snapshots")
oracle("sv11_refined_cohort", "SELECT * FROM refined")
oracle("sv12_labels_refined", "SELECT * FROM labels_refined")
oracle("sv13_cancellation_type", "SELECT subscription_id, subscription_term_id, cancellation_type FROM typed")
oracle("sv14_valid_cohort", "SELECT subscription_id, subscription_term_id, cancellation_type FROM valid")
oracle("sv14_valid_cohort_on_term", f"SELECT subscription_id, subscription_term_id, cancellation_type FROM typed WHERE {_CLEAR}")
oracle("sv15_single_plan_subscriptions", "SELECT * FROM single_plan")
oracle("sv16_first_plan_activated", "SELECT * FROM first_plan")
oracle("sv17_wanted_plan_fell_out", "SELECT *, count(*) AS n_plans FROM wanted_plan GROUP BY ALL")
oracle("sv18_latest_plan", """SELECT r.subscription_id, r.subscription_term_id, drug_name, drug_strength, regimen, term_months,
    monthly_dose FROM refined r JOIN latest p ON p.subscription_term_id = r.subscription_term_id""")
oracle("bk5_subscriber_types_per_term", """
    SELECT subscription_term_id, CASE WHEN any_value(cancel_requested_at) IS NOT NULL THEN 'voluntary_churner'
      WHEN any_value(term_ended_at) IS NOT NULL THEN 'involuntary_churner' ELSE 'retained' END AS subscriber_type,
      max(week_number) AS last_week FROM snapshots GROUP BY subscription_term_id""")


def _gold(strict):
    windows = (7, 14, 30)

    def counted(alias, source, moment, link, conditions):
        measures = [
            f"coalesce(sum({value}) FILTER (WHERE s.snapshot_date - CAST(x.{moment} AS DATE) <= {w}), 0)::BIGINT AS {name}_{w}d"
            for name, value in conditions.items() for w in windows
        ]
        return f"""(SELECT s.subscription_term_id, s.week_number, {', '.join(measures)}
          FROM snapshots s LEFT JOIN {source} x ON x.{link} = s.{link}
           AND s.snapshot_date - CAST(x.{moment} AS DATE) BETWEEN 0 AND 30 GROUP BY ALL) {alias}"""

    def by_then(test, moment):
        extra = f" AND CAST(x.{moment} AS DATE) <= s.snapshot_date" if strict else ""
        return f"CAST(coalesce(x.{test}{extra}, FALSE) AS INTEGER)"

    invoices = {"invoices": "1", "failed": by_then("is_failed", "failed_at"), "paid": by_then("is_paid", "paid_at"),
                "refunded": by_then("is_refunded", "refunded_at")}
    if not strict:
        invoices |= {"delinquent": "CAST(x.is_delinquent AS INTEGER)", "charges": "x.num_charges"}
    # A row that matched nothing has no date, so no FILTER lets it through.
    deferrals = {"deferrals": "1", "days_deferred": "CAST(x.new_renewal_at AS DATE) - CAST(x.old_renewal_at AS DATE)"}
    moved = "(SELECT * FROM int_subs_kafka__events WHERE event_name = 'term_renewal_time_changed' AND changed_by = 'CHANGED_BY_USER')"
    sent = "(SELECT * FROM int_subs_kafka__events WHERE event_name = 'upcoming_term_renewal_notified')"
    plans = {"plan_starts": "1", "plan_changes": "CAST(x.plan_term_number > 1 AS INTEGER)"}
    key = "(subscription_term_id, week_number)"
    return f"""
      SELECT s.subscription_id, subscription_term_id, snapshot_date, week_number, days_since_term_start,
             u.first_platform, {CHANNEL_GROUP},
             i.* EXCLUDE {key}, d.* EXCLUDE {key}, r.* EXCLUDE {key}, p.* EXCLUDE {key}, label
      FROM snapshots s JOIN subscriptions_core u USING (subscription_id)
      JOIN {counted('i', 'subscription_invoices', 'created_at', 'subscription_term_id', invoices)} USING {key}
      JOIN {counted('d', moved, 'occurred_at', 'subscription_id', deferrals)} USING {key}
      JOIN {counted('r', sent, 'occurred_at', 'subscription_id', {'reminders': '1'})} USING {key}
      JOIN {counted('p', 'subscription_plan_terms', 'plan_term_started_at', 'subscription_term_id', plans)} USING {key}"""


oracle("g1_plan_at_snapshot", """
    SELECT t.subscription_id, t.subscription_term_id, t.week_number, t.snapshot_date, x.term_months, x.drug_name, x.regimen
    FROM snapshots t LEFT JOIN subscription_plan_terms x ON x.subscription_term_id = t.subscription_term_id
     AND CAST(x.plan_term_started_at AS DATE) <= t.snapshot_date
    QUALIFY row_number() OVER (PARTITION BY t.subscription_term_id, t.week_number
                               ORDER BY x.plan_term_started_at DESC, x.plan_term_number DESC) = 1""")
oracle("g1_snapshot_features", _gold(strict=False))
oracle("g1_snapshot_features_strict", _gold(strict=True))
