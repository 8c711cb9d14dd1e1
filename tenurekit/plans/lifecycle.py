"""From sign-up to cancel, and who fell out before activation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenurekit.functions.buckets import activation_group, lifecycle_stage
from tenurekit.functions.columns import days_between, is_true
from tenurekit.operators import cohort as co
from tenurekit.operators import summaries as sm
from tenurekit.operators.cohort import SUB, TERM
from tenurekit.operators.lookback import RX_WRITTEN
from tenurekit.operators.survival import cancel_durations, kaplan_meier
from tenurekit.plans.registry import named


@named("q02_1_funnel")
def _(lake):
    steps = {
        "rx_written": F.col("rx_is_written"),
        "paid": F.col("is_paid"),
        "activated": F.col("is_activated"),
    }
    return sm.funnel(lake.people, steps)


@named("q02_2_lifecycle_stage")
def _(lake):
    staged = lake.people.select(lifecycle_stage().alias("lifecycle_stage"))
    return sm.share(staged, ["lifecycle_stage"]).orderBy(F.desc("n"))


def _first_rx(lake):
    """First prescription event per cohort subscription, found before the cohort is joined."""
    written = lake.cohort_events.filter(F.col("event_name") == RX_WRITTEN)
    return co.restrict_to(written.groupBy(SUB).agg(F.min("occurred_at").alias("rx_at")), lake.qualified)


@named("q02_3_days_signup_to_rx")
def _(lake):
    rows = lake.people.select(SUB, "created_at").join(_first_rx(lake), SUB)
    days = rows.select(days_between("created_at", "rx_at").alias("days_to_rx"))
    return sm.share(days, ["days_to_rx"]).orderBy("days_to_rx")


@named("q02_4_days_rx_to_activation")
def _(lake):
    activated = lake.people.filter(F.col("is_activated")).select(SUB, "activated_at")
    days = activated.join(_first_rx(lake), SUB).select(
        days_between("rx_at", "activated_at").alias("days_rx_to_activation")
    )
    return sm.share(days, ["days_rx_to_activation"]).orderBy("days_rx_to_activation")


def _survival(column, stratum):
    def analysis(lake):
        plan = lake.latest_plan(F.col(column).alias(stratum))
        durations = cancel_durations(lake.cohort_terms, lake.calendar).select(TERM, "duration_days", "event")
        curve = kaplan_meier(durations.join(plan, TERM), stratum, origin=True)
        rounded = {c: F.round(c, 6) for c in ("duration_months", "survival", "ci_low", "ci_high")}
        return curve.withColumns(rounded).orderBy(stratum, "duration_days")

    return analysis


for _name, _column, _stratum in (
    ("q02_5_survival_by_cadence", "term_months", "cadence"),
    ("q02_6_survival_by_drug", "drug_name", "drug_name"),
    ("q02_7_survival_by_regimen", "regimen", "regimen"),
):
    named(_name)(_survival(_column, _stratum))


def _days_to_cancel(lake):
    """Cancelled terms of any subscription with the days from its activation to the cancel."""
    cancelled = lake.terms.filter(F.col("cancel_requested_at").isNotNull()).select(SUB, "cancel_requested_at")
    rows = cancelled.join(lake.people.select(SUB, "activated_at"), SUB)
    return rows.select(SUB, days_between("activated_at", "cancel_requested_at").alias("days_to_cancel"))


@named("q02_8_days_to_cancel")
def _(lake):
    return sm.share(_days_to_cancel(lake), ["days_to_cancel"]).orderBy("days_to_cancel")


@named("q02_9_single_plan_subscriptions")
def _(lake):
    plans = co.single_plan_subscriptions(lake.source["subscription_plan_terms"])
    return sm.counts(plans, ["term_months"])


def _days_to_cancel_by_cadence(lake):
    plans = co.single_plan_subscriptions(lake.source["subscription_plan_terms"])
    per_sub = sm.counts(_days_to_cancel(lake), [SUB, "days_to_cancel"])
    return sm.share(per_sub.join(plans, SUB), ["term_months", "days_to_cancel"], weight="n")


@named("q02_10_days_to_cancel_by_cadence")
def _(lake):
    return _days_to_cancel_by_cadence(lake).orderBy("term_months", F.desc("n"))


def _one_cadence(months):
    return lambda lake: _days_to_cancel_by_cadence(lake).filter(F.col("term_months") == months)


for _number, _months in ((11, 1), (12, 3), (13, 6)):
    named(f"q02_{_number}_days_to_cancel_cadence_{_months}")(_one_cadence(_months))


@named("q02_14_first_plan_activated")
def _(lake):
    plans = co.first_plan_of_activated(lake.people, lake.source["subscription_plan_terms"])
    return sm.counts(plans, ["drug_name", "regimen", "term_months", "monthly_dose"], distinct=SUB)


@named("q02_15_wanted_plan_fell_out")
def _(lake):
    plans = co.wanted_plan_of_fell_out(lake.people, lake.plan_types)
    return sm.counts(plans, ["drug_name", "regimen", "term_months", "monthly_dose"], weight="n_plans")


def _plan_mix(column):
    """Plans of activated and fell-out subscribers side by side, as shares within each group."""

    def analysis(lake):
        columns = [SUB, "is_activated", column]
        activated = co.first_plan_of_activated(lake.people, lake.source["subscription_plan_terms"])
        fell_out = co.wanted_plan_of_fell_out(lake.people, lake.plan_types)
        both = activated.select(columns).unionByName(fell_out.select(columns))
        grouped = both.withColumn("group", activation_group(unknown_is_activated=True))
        mix = sm.share(grouped, ["group", column], distinct=SUB, within=["group"])
        return mix.orderBy("group", F.desc("n"))

    return analysis


for _number, _column in ((16, "drug_name"), (17, "regimen"), (18, "term_months"), (19, "monthly_dose")):
    named(f"q02_{_number}_group_by_{_column}")(_plan_mix(_column))


def _fell_out(lake):
    return lake.people.filter(~F.col("is_activated"))


@named("q02_20_fell_out_rx_written")
def _(lake):
    status = F.when(F.col("rx_is_written"), "rx_written").otherwise("no_rx")
    return sm.share(_fell_out(lake).select(status.alias("rx_status")), ["rx_status"])


def _order_status(lake, ordered):
    ordered = ordered.select(SUB).distinct().withColumn("ordered", F.lit(1))
    rows = _fell_out(lake).select(SUB).join(ordered, SUB, "left")
    status = F.when(F.col("ordered") == 1, "has_order").otherwise("no_order")
    return sm.share(rows.select(status.alias("order_status")), ["order_status"])


@named("q02_21_fell_out_order_placed")
def _(lake):
    """On the conformed invoices, which hold activated subscriptions only."""
    terms = lake.cohort_rows("subscription_invoices").select(SUB, TERM).distinct()
    return _order_status(lake, co.restrict_to(terms, lake.qualified, TERM))


@named("q02_21_fell_out_order_placed_all_invoices")
def _(lake):
    return _order_status(lake, lake.source["subscription_invoices"])


@named("q02_22_group_by_platform_and_channel")
def _(lake):
    grouped = lake.people.withColumn("group", activation_group())
    by = ["group", "first_platform", "first_channel_grouping"]
    return sm.share(grouped, by, within=["group"], name="pct_within_group").orderBy("group", F.desc("n"))


@named("bk6_activation_group_counts")
def _(lake):
    groups = lake.people.select(activation_group().alias("group"), is_true("is_paid").alias("paid"))
    return sm.counts(groups, ["group", "paid"])
