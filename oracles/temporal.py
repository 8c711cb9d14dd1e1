"""Checks of the weekly series, look-back features and their statistics, in join-with-range form."""

from oracles import block, chi2_test, gamma_tail, oracle
from oracles.groups import CHANNEL_GROUP, DOSE_GROUP, STRENGTH_GROUP

_GROUP = """if(label = 1, 'churned', 'retained') AS "group\""""


def _window(source, link, moment, days=14, how="JOIN", condition="TRUE"):
    return f"""snapshots s {how} {source} x ON x.{link} = s.{link} AND {condition}
        AND CAST(x.{moment} AS DATE) BETWEEN s.snapshot_date - {days} AND s.snapshot_date"""


block("invoice_hits", f"""SELECT s.week_number, s.label, s.subscription_id, s.snapshot_date, x.* EXCLUDE (subscription_id)
    FROM {_window('cohort_invoices', 'subscription_term_id', 'created_at')}""")


def _weekly(source, measures):
    listed = ", ".join(f"{expr} AS {name}" for name, expr in measures.items())
    return f"SELECT week_number, {_GROUP}, {listed} FROM {source} WHERE week_number <= 26 GROUP BY 1, 2"


def _mean(expr):
    return f"CAST(sum({expr}) AS DOUBLE) / count({expr})"


_FLAG = "CAST(coalesce({}, FALSE) AS INTEGER)"
_RATES = {
    "failure_rate": _mean(_FLAG.format("is_failed")),
    "delinquency_rate": _mean(_FLAG.format("is_delinquent")),
    "refund_rate": _mean(_FLAG.format("is_refunded")),
    "avg_charges": _mean("num_charges"),
}
oracle("ft1_invoice_failure_by_week", _weekly("invoice_hits", {"failure_rate": _RATES["failure_rate"]}))
oracle("ft2_delinquency_by_week", _weekly("invoice_hits", {"delinquency_rate": _RATES["delinquency_rate"]}))
oracle("ft5_refunds_by_week", _weekly("invoice_hits", {"refund_rate": _RATES["refund_rate"]}))
oracle("ft6_charges_by_week", _weekly("invoice_hits", {"avg_charges": _RATES["avg_charges"]}))
block("daily_fills", """SELECT subscription_term_id, CAST(created_at AS DATE) AS d, count(*) FILTER (WHERE is_paid) AS fills
    FROM cohort_invoices GROUP BY ALL""")
_FILLS = {"avg_fills": _mean("fills"), "avg_refills": _mean("greatest(fills - 1, 0)")}
_FILL_ROWS = f"(SELECT s.week_number, s.label, x.fills FROM {_window('daily_fills', 'subscription_term_id', 'd')}) f"
oracle("ft3_fills_by_week", _weekly(_FILL_ROWS, _FILLS))
oracle("st9_invoice_series_all", f"""SELECT * FROM ({_weekly('invoice_hits', _RATES)}) r
    JOIN ({_weekly(_FILL_ROWS, _FILLS)}) f USING (week_number, "group")""")
oracle("ft4_fills_per_snapshot", """SELECT subscription_id, snapshot_date, label, count(*) FILTER (WHERE is_paid) AS num_fills
    FROM invoice_hits GROUP BY ALL""")

block("moves", """SELECT *, CAST(new_renewal_at AS DATE) - CAST(old_renewal_at AS DATE) AS moved_days FROM cohort_events
    WHERE event_name = 'term_renewal_time_changed' AND changed_by = 'CHANGED_BY_USER'""")
block("dated_moves", "SELECT * FROM moves WHERE old_renewal_at IS NOT NULL AND new_renewal_at IS NOT NULL")
block("notices", "SELECT * FROM cohort_events WHERE event_name = 'upcoming_term_renewal_notified'")


def _daily_events(source, extra=""):
    daily = f"(SELECT subscription_id, CAST(occurred_at AS DATE) AS d, count(*) AS n {extra} FROM {source} GROUP BY ALL)"
    return _window(daily, "subscription_id", "d", how="LEFT JOIN")


oracle("ft7_deferrals_by_week", _weekly(
    f"(SELECT s.week_number, s.label, x.n, x.days FROM {_daily_events('dated_moves', ', sum(moved_days) AS days')}) e",
    {"has_deferred": _mean("CAST(n IS NOT NULL AS INTEGER)"), "avg_num_deferrals": _mean("coalesce(n, 0)"),
     "avg_days_deferred": _mean("coalesce(days, 0)")}))
oracle("ft9_reminders_by_week", _weekly(
    f"(SELECT s.week_number, s.label, x.n FROM {_daily_events('notices')}) e",
    {"has_reminder": _mean("CAST(n IS NOT NULL AS INTEGER)"), "avg_reminders": _mean("coalesce(n, 0)")}))
block("deferred_days", f"""SELECT s.subscription_id, s.snapshot_date, s.label, CAST(coalesce(sum(x.moved_days), 0) AS BIGINT) AS total_days_deferred
    FROM {_window('dated_moves', 'subscription_id', 'occurred_at', how='LEFT JOIN')} GROUP BY ALL""")
oracle("ft8_days_deferred_per_snapshot", "SELECT * FROM deferred_days")

_KINDS = {"drug_change": "drug_name", "regimen_change": "regimen", "strength_change": "drug_strength",
          "dose_change": "monthly_dose", "fulfillment_change": "starting_fulfillment_type"}
block("plans_before", "SELECT *, " + ", ".join(
    f"lag({c} IGNORE NULLS) OVER (PARTITION BY subscription_term_id ORDER BY plan_term_started_at, plan_term_number) AS before_{c}"
    for c in _KINDS.values()) + " FROM cohort_plan_terms")
oracle("ft10_plan_changes_by_week", _weekly(
    f"(SELECT s.week_number, s.label, x.* FROM {_window('plans_before', 'subscription_term_id', 'plan_term_started_at')}) p",
    {"has_plan_change": _mean("CAST(plan_term_number > 1 AS INTEGER)")} |
    {k: _mean(f"CAST(coalesce(plan_term_number > 1 AND {c} <> before_{c}, FALSE) AS INTEGER)") for k, c in _KINDS.items()}))
oracle("ft11_static_profile", f"""
    SELECT {STRENGTH_GROUP}, {DOSE_GROUP}, regimen, {CHANNEL_GROUP},
           {_GROUP}, count(DISTINCT s.subscription_id) AS n
    FROM snapshots s JOIN latest p ON p.subscription_term_id = s.subscription_term_id
    JOIN subscriptions_core u ON u.subscription_id = s.subscription_id GROUP BY ALL""")


def _candidate(feature, window, value, source, link, moment, how="JOIN"):
    return f"""SELECT '{feature}' AS feature, {window} AS window_days, s.subscription_id, s.label, CAST({value} AS BIGINT) AS val
        FROM {_window(source, link, moment, window, how)} GROUP BY s.subscription_id, s.label"""


_INVOICE = ("cohort_invoices", "subscription_term_id", "created_at")
_FEATURES = {
    "invoice_failure": ("CAST(bool_or(x.is_failed) AS INTEGER)", *_INVOICE),
    "delinquency": ("CAST(bool_or(x.is_delinquent) AS INTEGER)", *_INVOICE),
    "num_fills": ("count(*) FILTER (WHERE x.is_paid)", *_INVOICE),
    "refund_count": ("count(*) FILTER (WHERE x.is_refunded)", *_INVOICE),
    "num_charges": ("sum(x.num_charges)", *_INVOICE),
    "has_deferral": ("CAST(count(x.event_id) > 0 AS INTEGER)", "moves", "subscription_id", "occurred_at", "LEFT JOIN"),
    "refill_reminder": ("CAST(count(x.event_id) > 0 AS INTEGER)", "notices", "subscription_id", "occurred_at", "LEFT JOIN"),
    "has_plan_change": ("CAST(bool_or(x.plan_term_number > 1) AS INTEGER)", "cohort_plan_terms", "subscription_term_id",
                        "plan_term_started_at"),
}
block("candidates", " UNION ALL ".join(_candidate(f, w, *spec) for f, spec in _FEATURES.items() for w in (7, 14, 30)))
oracle("ft12_window_candidates", "SELECT * FROM candidates")
_TABLE = "SELECT feature, window_days, count(*) AS n, count(*) FILTER (WHERE label = 1) AS k FROM candidates GROUP BY feature, window_days, val > 0"
block("candidate_tests", f"""SELECT feature, window_days, if(dof = 1, chi2, NULL) AS chi2, if(dof = 1, p_value, NULL) AS p_value
    FROM ({chi2_test(_TABLE, 'feature, window_days')}) t""")
oracle("st2_candidate_tests", """SELECT feature, window_days, round(chi2, 4) AS chi2, p_value, p_value < 0.05 AS significant
    FROM candidate_tests""")
oracle("st3_best_windows", """
    SELECT feature, max(c) FILTER (WHERE window_days = 7) AS "7d", max(c) FILTER (WHERE window_days = 14) AS "14d",
           max(c) FILTER (WHERE window_days = 30) AS "30d",
           CAST((list(window_days ORDER BY c DESC, window_days) FILTER (WHERE c IS NOT NULL))[1] AS VARCHAR) || 'd' AS best_window
    FROM (SELECT feature, window_days, round(chi2, 2) AS c FROM candidate_tests) r GROUP BY feature""")

block("fills", """SELECT label, count(*) FILTER (WHERE is_paid) AS num_fills FROM invoice_hits
    GROUP BY subscription_id, snapshot_date, label""")
oracle("st5_fills_mann_whitney", f"""
    SELECT n_1, n_0, u AS u_statistic, round(z, 6) AS z, round(p, 6) AS p_value, p < 0.05 AS significant
    FROM (SELECT *, {gamma_tail('0.5', 'z * z / 2')} AS p FROM (
      SELECT CAST(a AS BIGINT) AS n_1, CAST(b AS BIGINT) AS n_0, u,
             greatest(0.0, (greatest(u, a * b - u) - a * b / 2 - 0.5) / sqrt(a * b / 12 * (a + b + 1 - ties / ((a + b) * (a + b - 1))))) AS z
      FROM (SELECT CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) AS b,
                   sum(mid) FILTER (WHERE label = 1) - a * (a + 1) / 2 AS u FROM (
              SELECT label, rank() OVER (ORDER BY num_fills) + (count(*) OVER (PARTITION BY num_fills) - 1) / 2.0 AS mid FROM fills) r) s,
           (SELECT CAST(sum(power(t, 3) - t) AS DOUBLE) AS ties FROM (SELECT count(*) AS t FROM fills GROUP BY num_fills) g) k) z) w""")


def _density(source, value, points):
    return f"""
      SELECT label, point, round(lo + point * step, 6) AS x,
             round(sum(n * exp(-0.5 * power((lo + point * step - v) / h, 2))) / (any_value(total) * any_value(h) * sqrt(2 * pi())), 8) AS density
      FROM (SELECT label, CAST({value} AS DOUBLE) AS v, count(*) AS n FROM {source} GROUP BY ALL) c
      JOIN (SELECT label, min({value})::DOUBLE AS lo, (max({value}) - min({value}))::DOUBLE / {points - 1} AS step, count(*) AS total,
                   stddev_samp({value}) * power(count(*), -0.2) AS h FROM {source} GROUP BY label) s USING (label),
           (SELECT CAST(unnest(range(0, {points})) AS INTEGER) AS point) g
      GROUP BY label, point, lo, step"""


oracle("st6_days_deferred_density", _density(
    "(SELECT * FROM deferred_days WHERE total_days_deferred > 0) d", "total_days_deferred", 300))
oracle("st8_fills_violin", _density("fills", "num_fills", 100))
oracle("st8_fills_box", """
    SELECT label, n, q1, median, q3, least(q1, min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1))) AS whisker_low,
           greatest(q3, max(v) FILTER (WHERE v <= q3 + 1.5 * (q3 - q1))) AS whisker_high,
           count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS n_outliers
    FROM (SELECT label, CAST(num_fills AS DOUBLE) AS v FROM fills) f
    JOIN (SELECT label, count(*) AS n, quantile_cont(CAST(num_fills AS DOUBLE), 0.25) AS q1,
                 quantile_cont(CAST(num_fills AS DOUBLE), 0.5) AS median, quantile_cont(CAST(num_fills AS DOUBLE), 0.75) AS q3
          FROM fills GROUP BY label) b USING (label) GROUP BY label, n, q1, median, q3""")
