"""Cancel rates in the first 30 days by attribute, each with its test of association.

Day-0 cancels are left out: they are decided before anything can be done.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tenurekit.functions.buckets import DOSE_HIGH_DAILY, DOSE_LOW, DOSE_MID, channel_group, dose_group, strength_group
from tenurekit.operators import summaries as sm
from tenurekit.operators.association import chi_square
from tenurekit.operators.cohort import SUB, TERM
from tenurekit.operators.features import failed_invoices_at_start
from tenurekit.plans.registry import named
from tenurekit.plans.sanity import cohort_size
from tenurekit.sources.tables import distinct_values

HIT = "cancelled_in_30_days"


@named("q04_1_refined_cohort_size")
def _(lake):
    return cohort_size(lake.refined)


@named("q04_2_labels_refined")
def _(lake):
    return lake.labels_refined.select(SUB, TERM, "term_started_at", "cancel_requested_at", "cancel_status", "is_cancelled")


@named("q04_3_labelled_size")
def _(lake):
    return cohort_size(lake.labels_refined)


@named("q04_4_status_share")
def _(lake):
    return sm.share(lake.labels_refined, ["cancel_status"], places=2).orderBy(F.desc("n"))


def at_risk(lake):
    """Labelled terms that did not cancel on their first day."""
    return lake.labels_refined.filter(F.col("cancel_status") != "cancelled_at_start").select(
        SUB, TERM, "cancel_status"
    )


def rate(rows, dims, **options):
    return sm.rate_by(rows, dims, F.col("cancel_status") == HIT, **options)


def tested(rates):
    return chi_square(rates).withColumns({"chi2": F.round("chi2", 6), "p_value": F.round("p_value", 6)})


def by_plan(lake, attributes):
    """Labelled terms with attributes of their current plan."""
    plan = lake.latest_plan(*(make().alias(name) for name, make in attributes.items()))
    return at_risk(lake).join(plan, TERM)


def by_person(lake, attributes):
    people = lake.cohort_rows("subscriptions" if "user_state" in attributes else "subscriptions_core")
    return at_risk(lake).join(people.select(SUB, *(make().alias(name) for name, make in attributes.items())), SUB)


def _column(name):
    return lambda: F.col(name)


def _dose_named():
    return dose_group("monthly_dose", keep_unknown=True, names=(DOSE_LOW, DOSE_MID, DOSE_HIGH_DAILY))


def cadence_rates(lake):
    """The flagship: label, current plan, rate."""
    return rate(by_plan(lake, {"cadence": _column("term_months")}), ["cadence"]).orderBy("cadence")


named("q04_5_rate_by_cadence")(cadence_rates)

_PLAN_RATES = {
    "q04_6_rate_by_drug": {"drug_name": _column("drug_name")},
    "q04_7_rate_by_drug_and_regimen": {"drug_name": _column("drug_name"), "regimen": _column("regimen")},
    "q04_8_rate_by_regimen": {"regimen": _column("regimen")},
    "q04_9_rate_by_strength": {"drug_strength": _column("drug_strength")},
    "q04_10_rate_by_strength_group": {"strength_group": lambda: strength_group("drug_strength", keep_unknown=True)},
    "q04_11_rate_by_monthly_dose": {"monthly_dose": _column("monthly_dose")},
    "q04_12_rate_by_dose_group": {"dose_group": _dose_named},
}
_PERSON_RATES = {
    "q04_15_rate_by_channel": {"first_channel_grouping": _column("first_channel_grouping")},
    "q04_16_rate_by_channel_group": {"channel_group": lambda: channel_group("first_channel_grouping")},
    "q04_17_rate_by_platform": {"first_platform": _column("first_platform")},
    "q04_18_rate_by_state": {"user_state": _column("user_state")},
}
_MIN_STATE = 100


def _rates(frame, attributes, **options):
    return lambda lake: rate(frame(lake, attributes), list(attributes), **options)


def _register(name, rates):
    named(name)(lambda lake: rates(lake).orderBy(F.desc("cancel_rate_pct")))


for _name, _attributes in _PLAN_RATES.items():
    _register(_name, _rates(by_plan, _attributes))
    if _name != "q04_7_rate_by_drug_and_regimen":
        named(f"{_name}_chi2")(lambda lake, _r=_rates(by_plan, _attributes): tested(_r(lake)))

for _name, _attributes in _PERSON_RATES.items():
    _options = {"min_n": _MIN_STATE} if "user_state" in _attributes else {}
    _register(_name, _rates(by_person, _attributes, **_options))
    named(f"{_name}_chi2")(lambda lake, _r=_rates(by_person, _attributes, **_options): tested(_r(lake)))


@named("q04_5_rate_by_cadence_chi2")
def _(lake):
    return tested(rate(by_plan(lake, {"cadence": _column("term_months")}), ["cadence"]))


@named("q04_7_rate_by_drug_as_needed_chi2")
def _(lake):
    rows = by_plan(lake, {"drug_name": _column("drug_name"), "regimen": _column("regimen")})
    return tested(rate(rows.filter(F.col("regimen") == "AS_NEEDED"), ["drug_name"]))


@named("q04_13_fulfillment_methods")
def _(lake):
    return distinct_values(lake.plan_types, "fulfillment_method")


@named("q04_14_rate_by_failed_invoices")
def _(lake):
    history = failed_invoices_at_start(lake.cohort_rows("subscription_invoices"), lake.labels_refined)
    return rate(at_risk(lake).join(history, TERM), ["failed_invoice_count"]).orderBy("failed_invoice_count")


@named("ft13_failed_invoices_at_start")
def _(lake):
    return failed_invoices_at_start(lake.cohort_rows("subscription_invoices"), lake.labels_refined)
