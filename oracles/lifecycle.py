"""Checks of the lifecycle and fell-out analyses."""

from oracles import block, oracle, pct, share

_STEPS = {"rx_written": "rx_is_written", "paid": "is_paid", "activated": "is_activated"}
oracle("q02_1_funnel", "SELECT signup, " + ", ".join(f"{s}, {pct(s, 'signup')} AS pct_{s}" for s in _STEPS) +
       " FROM (SELECT count(DISTINCT subscription_id) AS signup, " +
       ", ".join(f"count(*) FILTER (WHERE {c}) AS {s}" for s, c in _STEPS.items()) + " FROM subscriptions_core) f")
oracle("q02_2_lifecycle_stage", share("subscriptions_core", """CASE WHEN is_activated THEN 'activated'
    WHEN rx_is_written THEN 'rx_written_not_activated' WHEN NOT is_paid THEN 'fell_out_before_rx' ELSE 'other' END AS lifecycle_stage"""))
block("first_rx", """SELECT subscription_id, CAST(min(occurred_at) AS DATE) AS rx_day FROM cohort_events
    WHERE event_name = 'condition_subscription_prescription_written' GROUP BY subscription_id""")
oracle("q02_3_days_signup_to_rx", share("subscriptions_core JOIN first_rx USING (subscription_id)",
       "CAST(rx_day - CAST(created_at AS DATE) AS INTEGER) AS days_to_rx"))
oracle("q02_4_days_rx_to_activation", share(
       "(SELECT * FROM subscriptions_core JOIN first_rx USING (subscription_id) WHERE is_activated) a",
       "CAST(CAST(activated_at AS DATE) - rx_day AS INTEGER) AS days_rx_to_activation"))


def _survival(column, stratum):
    """Product-limit curve from grouped deaths and a row at time 0, with risk sets counted from the back."""
    durations = f"durations_by_{stratum}"
    block(durations, f"""SELECT {column} AS {stratum}, CAST(coalesce(CAST(c.cancel_requested_at AS DATE), DATE '2001-08-02')
                     - CAST(c.term_started_at AS DATE) AS INTEGER) AS duration_days, CAST(c.cancel_requested_at IS NOT NULL AS INTEGER) AS seen
            FROM cohort c JOIN latest p ON p.subscription_term_id = c.subscription_term_id
            WHERE {column} IS NOT NULL AND (c.cancel_requested_at IS NULL OR c.cancel_requested_at > c.term_started_at)""")
    return f"""
      SELECT {stratum}, duration_days, round(duration_days / 30.0, 6) AS duration_months, CAST(at_risk AS BIGINT) AS at_risk,
             CAST(d AS BIGINT) AS n_events, round(s, 6) AS survival,
             CASE WHEN s = 0 THEN NULL WHEN s = 1 THEN 1.0 ELSE round(power(s, exp(1.959963984540054 * sqrt(v) / -ln(s))), 6) END AS ci_low,
             CASE WHEN s = 0 THEN NULL WHEN s = 1 THEN 1.0 ELSE round(power(s, exp(-1.959963984540054 * sqrt(v) / -ln(s))), 6) END AS ci_high
      FROM (
        SELECT *, product(1 - d / at_risk) OVER up AS s,
               sum(CASE WHEN at_risk > d THEN d / (at_risk * (at_risk - d)) ELSE 0 END) OVER up AS v
        FROM (
          SELECT {stratum}, duration_days, CAST(d AS DOUBLE) AS d,
                 CAST(sum(n) OVER (PARTITION BY {stratum} ORDER BY duration_days DESC) AS DOUBLE) AS at_risk
          FROM (
            SELECT {stratum}, duration_days, sum(n) AS n, sum(d) AS d FROM (
              SELECT {stratum}, duration_days, 1 AS n, seen AS d FROM {durations}
              UNION ALL SELECT DISTINCT {stratum}, 0, 0, 0 FROM {durations}) z
            GROUP BY ALL) g) r
        WINDOW up AS (PARTITION BY {stratum} ORDER BY duration_days)) k"""


oracle("q02_5_survival_by_cadence", _survival("p.term_months", "cadence"))
oracle("q02_6_survival_by_drug", _survival("p.drug_name", "drug_name"))
oracle("q02_7_survival_by_regimen", _survival("p.regimen", "regimen"))

block("cancel_days", """SELECT t.subscription_id, CAST(CAST(t.cancel_requested_at AS DATE) - CAST(s.activated_at AS DATE) AS INTEGER)
      AS days_to_cancel
    FROM subscription_terms t JOIN subscriptions_core s ON s.subscription_id = t.subscription_id
    WHERE t.cancel_requested_at IS NOT NULL""")
oracle("q02_8_days_to_cancel", share("cancel_days", "days_to_cancel"))
oracle("q02_9_single_plan_subscriptions", "SELECT term_months, count(*) AS n FROM single_plan GROUP BY 1")
_BY_CADENCE = share("cancel_days JOIN single_plan USING (subscription_id)", "term_months;days_to_cancel")
oracle("q02_10_days_to_cancel_by_cadence", _BY_CADENCE)
for _number, _months in ((11, 1), (12, 3), (13, 6)):
    oracle(f"q02_{_number}_days_to_cancel_cadence_{_months}", f"SELECT * FROM ({_BY_CADENCE}) b WHERE term_months = {_months}")

_PLAN = "drug_name, regimen, term_months, monthly_dose"
oracle("q02_14_first_plan_activated", f"SELECT {_PLAN}, count(DISTINCT subscription_id) AS n FROM first_plan GROUP BY ALL")
oracle("q02_15_wanted_plan_fell_out", f"SELECT {_PLAN}, count(*) AS n FROM wanted_plan GROUP BY ALL")
_BOTH = f"(SELECT subscription_id, is_activated, {_PLAN} FROM first_plan UNION ALL SELECT subscription_id, is_activated, {_PLAN} FROM wanted_plan) b"
for _number, _column in ((16, "drug_name"), (17, "regimen"), (18, "term_months"), (19, "monthly_dose")):
    oracle(f"q02_{_number}_group_by_{_column}", share(
        _BOTH, f"""if(is_activated, 'activated', 'fellout') AS "group";{_column}""", n="count(DISTINCT subscription_id)",
        within='"group"'))
_FELL_OUT = "(SELECT * FROM subscriptions_core WHERE NOT is_activated) f"
oracle("q02_20_fell_out_rx_written", share(_FELL_OUT, "if(rx_is_written, 'rx_written', 'no_rx') AS rx_status"))
for _name, _table in (("", "cohort_invoices"), ("_all_invoices", "subscription_invoices")):
    oracle(f"q02_21_fell_out_order_placed{_name}", share(
        _FELL_OUT, f"if(subscription_id IN (SELECT subscription_id FROM {_table}), 'has_order', 'no_order') AS order_status"))
oracle("q02_22_group_by_platform_and_channel", share(
    "subscriptions_core", """if(is_activated, 'activated', 'fell_out') AS "group";first_platform;first_channel_grouping""",
    within='"group"', names=("n", "pct_within_group")))
oracle("bk6_activation_group_counts", """SELECT if(is_activated, 'activated', 'fell_out') AS "group", is_paid AS paid, count(*) AS n
    FROM subscriptions_core GROUP BY ALL""")
