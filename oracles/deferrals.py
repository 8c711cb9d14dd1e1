"""Checks of the deferral analyses."""

from oracles import block, oracle, pct, share

_MOVED = "event_name = 'term_renewal_time_changed'"
_BY_USER = f"{_MOVED} AND changed_by = 'CHANGED_BY_USER'"
oracle("qd_1_deferrals_without_dates", f"""SELECT subscription_id, event_name, changed_by, old_renewal_at, new_renewal_at
    FROM int_subs_kafka__events WHERE {_BY_USER} AND coalesce(old_renewal_at, new_renewal_at) IS NULL""")
oracle("qd_2_event_volume", """SELECT event_name, changed_by, count(*) AS n_events, count(DISTINCT subscription_id) AS n_subscriptions
    FROM int_subs_kafka__events GROUP BY ALL""")
oracle("qd_3_deferral_reach", f"""
    SELECT c AS cohort_size, d AS n_deferred, {pct('d', 'c', 2)} AS pct_deferred, c - d AS n_never_deferred
    FROM (SELECT count(DISTINCT q.subscription_id) AS c, count(DISTINCT q.subscription_id) FILTER (WHERE q.subscription_id IN (
            SELECT subscription_id FROM int_subs_kafka__events WHERE {_BY_USER})) AS d FROM qualified q) r""")
block("user_moves", f"""SELECT e.* FROM int_subs_kafka__events e JOIN qualified q ON q.subscription_id = e.subscription_id
    WHERE {_BY_USER}""")
oracle("qd_4_deferral_counts", """SELECT n_deferrals, count(*) AS n_subscriptions
    FROM (SELECT subscription_id, count(*) AS n_deferrals FROM user_moves GROUP BY 1) c GROUP BY 1""")
oracle("qd_5_days_deferred", """SELECT CAST(CAST(new_renewal_at AS DATE) - CAST(old_renewal_at AS DATE) AS INTEGER) AS days_deferred,
    count(*) AS n_events FROM user_moves WHERE old_renewal_at IS NOT NULL AND new_renewal_at IS NOT NULL GROUP BY 1""")
block("last_moves", f"""SELECT subscription_id, max(new_renewal_at) AS new_renewal_at FROM int_subs_kafka__events WHERE {_BY_USER}
    GROUP BY subscription_id HAVING max(new_renewal_at) <= TIMESTAMP '2001-07-01'""")
block("renewals", """SELECT m.subscription_id, m.new_renewal_at, if(i.invoice_id IS NULL, 'no', 'yes') AS is_renewed
    FROM last_moves m LEFT JOIN cohort_invoices i ON i.subscription_id = m.subscription_id AND i.is_paid
    AND CAST(i.created_at AS DATE) >= CAST(m.new_renewal_at AS DATE)""")
_NAMES = ("n_subscriptions", "pct_subscriptions")
oracle("qd_6_renewed_after_deferral", share("renewals", "is_renewed", places=2, names=_NAMES))
oracle("qd_6_renewed_after_deferral_per_subscriber", share("(SELECT DISTINCT * FROM renewals) r", "is_renewed", places=2, names=_NAMES))
oracle("qd_7_ten_not_renewed", """SELECT subscription_id, new_renewal_at FROM renewals WHERE is_renewed = 'no'
    ORDER BY subscription_id LIMIT 10""")
for _name, _who in (("qd_8_outcome_by_deferral", _MOVED), ("qd_8_outcome_by_user_deferral", _BY_USER)):
    oracle(_name, f"""SELECT if(subscription_id IN (SELECT subscription_id FROM int_subs_kafka__events WHERE {_who}), 'deferred',
        'never deferred') AS deferral_group, term_status, termination_type, count(DISTINCT subscription_id) AS n_subscriptions
        FROM all_terms GROUP BY ALL""")
oracle("qd_9_days_before_renewal", f"""SELECT CAST(CAST(old_renewal_at AS DATE) - CAST(occurred_at AS DATE) AS INTEGER) AS days_before_renewal,
    count(*) AS n_events FROM int_subs_kafka__events e JOIN qualified q ON q.subscription_id = e.subscription_id
    WHERE {_MOVED} AND old_renewal_at IS NOT NULL GROUP BY 1""")
