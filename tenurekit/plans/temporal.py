"""Behaviour over the weeks since start, and how long a look-back window should be."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenurekit.operators import features as ft
from tenurekit.operators.association import best_windows, candidate_tests, mann_whitney
from tenurekit.operators.density import box_summary, kernel_density, violin
from tenurekit.plans.registry import named

WINDOW, MAX_WEEK, WINDOWS = 14, 26, (7, 14, 30)


_sources = {
    "invoices": lambda lake: lake.cohort_rows("subscription_invoices"),
    "events": lambda lake: lake.cohort_events,
    "plans": lambda lake: lake.plan_steps,
}


def _weekly(build, source, *columns):
    def analysis(lake):
        series = build(_sources[source](lake), lake.bounds, lake.calendar, WINDOW, MAX_WEEK)
        return series.select(*ft.WEEK, *columns).orderBy(*ft.WEEK)

    return analysis


for _name, _build, _source, _columns in (
    ("ft1_invoice_failure_by_week", ft.invoice_series, "invoices", ["failure_rate"]),
    ("ft2_delinquency_by_week", ft.invoice_series, "invoices", ["delinquency_rate"]),
    ("ft3_fills_by_week", ft.invoice_series, "invoices", ["avg_fills", "avg_refills"]),
    ("ft5_refunds_by_week", ft.invoice_series, "invoices", ["refund_rate"]),
    ("ft6_charges_by_week", ft.invoice_series, "invoices", ["avg_charges"]),
    ("ft7_deferrals_by_week", ft.deferral_series, "events", ["has_deferred", "avg_num_deferrals", "avg_days_deferred"]),
    ("ft9_reminders_by_week", ft.reminder_series, "events", ["has_reminder", "avg_reminders"]),
    ("ft10_plan_changes_by_week", ft.plan_change_series, "plans", ["has_plan_change", *ft.PLAN_ATTRIBUTES]),
):
    named(_name)(_weekly(_build, _source, *_columns))


@named("st9_invoice_series_all")
def _(lake):
    """Every invoice series of the report from one pass."""
    return ft.invoice_series(_sources["invoices"](lake), lake.bounds, lake.calendar, WINDOW, MAX_WEEK)


def _fills(lake):
    return ft.fills_per_snapshot(_sources["invoices"](lake), lake.bounds, lake.calendar, WINDOW)


def _deferred_days(lake, keep_zero):
    return ft.days_deferred_per_snapshot(lake.cohort_events, lake.bounds, lake.calendar, WINDOW, keep_zero)


@named("ft4_fills_per_snapshot")
def _(lake):
    return _fills(lake)


@named("ft8_days_deferred_per_snapshot")
def _(lake):
    return _deferred_days(lake, keep_zero=True)


@named("ft11_static_profile")
def _(lake):
    return ft.static_profile(lake.bounds, _sources["plans"](lake), lake.people, lake.calendar)


def _candidates(lake):
    return ft.window_candidates(lake.profile, lake.days, lake.calendar, WINDOWS)


@named("ft12_window_candidates")
def _(lake):
    return _candidates(lake)


@named("st2_candidate_tests")
def _(lake):
    tests = candidate_tests(_candidates(lake))
    return tests.withColumns({"chi2": F.round("chi2", 4), "p_value": F.round("p_value", 6)})


@named("st3_best_windows")
def _(lake):
    return best_windows(candidate_tests(_candidates(lake)), WINDOWS).orderBy("best_window", "feature")


@named("st5_fills_mann_whitney")
def _(lake):
    test = mann_whitney(_fills(lake), "num_fills")
    return test.withColumns({"z": F.round("z", 6), "p_value": F.round("p_value", 6)})


@named("st6_days_deferred_density")
def _(lake):
    positive = _deferred_days(lake, keep_zero=False).filter(F.col("total_days_deferred") > 0)
    curve = kernel_density(positive, "total_days_deferred")
    return curve.withColumns({"x": F.round("x", 6), "density": F.round("density", 8)})


@named("st8_fills_box")
def _(lake):
    return box_summary(_fills(lake), "num_fills")


@named("st8_fills_violin")
def _(lake):
    return violin(_fills(lake), "num_fills").withColumns({"x": F.round("x", 6), "density": F.round("density", 8)})
