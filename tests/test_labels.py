"""Hand-worked boundary cases of cohort, labels, snapshots and cancellation types."""

from datetime import date, timedelta

import pytest
from conftest import on
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tenurekit.functions.buckets import dose_group, strength_group, subscriber_type
from tenurekit.operators import checks, cohort, conform, labels

CASES = {
    # case: (start, cancel, end)
    "m1": ("2026-03-01", "2026-03-01", None),
    "m2": ("2026-03-01", "2026-03-02", None),
    "m3": ("2026-03-01", "2026-03-31", None),
    "m4": ("2026-03-01", "2026-04-01", None),
    "m5": ("2026-05-01", "2026-07-01", None),
    "m6": ("2026-05-31", None, None),
    "m7": ("2026-06-01", None, None),
    "m8": ("2026-01-01", None, "2026-02-15"),
    "m9": ("2026-01-01", None, "2026-06-30 10:00"),
    "m10": ("2026-01-01", None, "2026-07-01"),
    "m11": ("2024-01-01", None, None),
    "m12": (None, None, None),
}


@pytest.fixture(scope="module")
def terms(make_terms):
    rows = [(case, *dates) for case, dates in CASES.items()]
    return make_terms(*rows, ("m13/a", "2026-01-01", None, None), ("m13/b", "2026-02-01", None, None))


@pytest.fixture(scope="module")
def members(terms, make_subs, cal):
    return cohort.cohort_terms(terms, make_subs(*CASES, "m13"), cal)


def test_cohort_bounds(terms, make_subs, cal):
    found = {r.subscription_id for r in cohort.qualified_terms(terms, make_subs(*CASES, "m13"), cal).collect()}
    assert found == {"m1", "m2", "m3", "m4", "m5", "m6", "m8", "m9", "m10", "m11", "m13"}


def test_unpaid_or_inactive_is_out(terms, make_subs, cal):
    assert cohort.qualified_terms(terms, make_subs("m1", paid=False), cal).isEmpty()
    assert cohort.qualified_terms(terms, make_subs("m1", activated=None), cal).isEmpty()


def test_two_first_terms_are_refined_away(members, terms):
    refined = {r.subscription_id for r in cohort.refine(members, terms).collect()}
    assert "m13" not in refined and "m1" in refined


def test_start_labels(members, cal):
    got = {r.subscription_id: (r.cancel_status, r.is_cancelled) for r in labels.start_label(members, cal).collect()}
    assert got["m1"] == ("cancelled_at_start", 1)
    assert got["m2"] == ("cancelled_in_30_days", 1)
    assert got["m3"] == ("cancelled_in_30_days", 1)
    assert got["m4"] == ("not_cancelled", 0)
    assert got["m5"] == ("not_cancelled", 0)
    assert "m8" not in got, "ended silently before the cutoff"
    assert got["m9"] == ("not_cancelled", 0), "ended later on the cutoff day: the timestamp decides"
    assert got["m10"] == ("not_cancelled", 0)


def test_snapshots(members, cal):
    rows = labels.weekly_snapshots(labels.snapshot_bounds(members, cal), cal).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.subscription_term_id, r.week_number)):
        got.setdefault(r.subscription_id, []).append(r.label)
    assert "m1" not in got
    assert got["m2"] == [1]
    assert got["m3"] == [1] * 5
    assert got["m4"] == [0] + [1] * 4
    assert got["m5"] == [0] * 5
    assert got["m6"] == [0]
    assert got["m8"] == [0] * 3
    assert len(got["m11"]) == 53
    last = max(r.snapshot_date for r in rows if r.subscription_id == "m5")
    assert last == on("2026-05-29")


def test_cancel_flag_before_cutoff(members, cal):
    got = {r.subscription_id: r for r in conform.with_cancel_before_cutoff(members, cal).collect()}
    assert got["m4"].cancel_status_before_cutoff == "cancelled" and got["m4"].is_cancelled_before_cutoff is True
    assert got["m5"].cancel_status_before_cutoff == "not_cancelled" and got["m5"].is_cancelled_before_cutoff is False
    assert got["m6"].is_cancelled_before_cutoff is False


def test_cancellation_types(members, cal):
    got = {r.subscription_id: r.cancellation_type for r in cohort.with_cancellation_type(members, cal).collect()}
    assert got["m4"] == "voluntary_cancellation"
    assert got["m5"] == "not_cancelled"
    assert got["m8"] == "involuntary_cancellation"
    assert got["m9"] == "involuntary_cancellation", "here the date decides"
    assert got["m10"] == "not_cancelled"


def test_cancel_after_cutoff_and_end_before_has_no_type(make_terms, cal):
    odd = make_terms(("x", "2026-01-01", "2026-07-01", "2026-06-01"))
    assert cohort.with_cancellation_type(odd, cal).first().cancellation_type == "not_cancelled"


def test_any_end_is_involuntary_for_subscriber_type(members):
    kind = subscriber_type("cancel_requested_at", "term_ended_at").alias("kind")
    got = dict(members.select("subscription_id", kind).collect())
    assert got["m10"] == "involuntary_churner" and got["m6"] == "retained" and got["m5"] == "voluntary_churner"


def test_valid_cohort_counts_rows_and_drops_ambiguous(make_terms, cal):
    terms = make_terms(
        ("a", "2026-01-01", None, "2026-03-01", False),  # silent end, flag explicitly false: ambiguous
        ("b", "2026-01-01", None, "2026-03-01", None),  # null flag means the payment failed
        ("c/1", "2026-01-01", None, "2026-03-01", False),  # ambiguous first term …
        ("c/2", "2026-04-01", None, None, False, 2),  # … but two later terms bring it back twice
        ("c/3", "2026-05-01", None, None, False, 3),
    )
    typed = cohort.with_cancellation_type(terms.filter("term_number = 1"), cal)
    by_sub = {r.subscription_id: r.n_rows for r in cohort.valid_cohort(typed, terms).collect()}
    assert by_sub == {"b": 1, "c": 2}
    assert cohort.repeat_rows(cohort.valid_cohort(typed, terms)).count() == 3
    assert {r.subscription_id for r in cohort.valid_cohort(typed, terms, on_term=True).collect()} == {"b"}


def test_buckets_outside_the_lists(spark):
    df = spark.createDataFrame([("15mg", 20), ("5mg", 8), (None, None)], "s string, d int")
    plain = df.select(strength_group("s").alias("s"), dose_group("d").alias("d")).collect()
    assert [tuple(r) for r in plain] == [(None, None), ("low (≤5mg)", "low (≤8/mo)"), (None, None)]
    raw = df.select(strength_group("s", keep_unknown=True).alias("s"), dose_group("d", keep_unknown=True).alias("d"))
    assert tuple(raw.first()) == ("15mg", "20")


def test_checks_hold_on_the_cases(members, terms, cal):
    bounds = labels.snapshot_bounds(members, cal)
    snapshots = labels.weekly_snapshots(bounds, cal)
    label_bad = checks.run_checks(labels.start_label(members, cal), checks.label_checks(cal))
    snapshot_bad = checks.run_checks(snapshots, checks.snapshot_checks(cal))
    stop_bad = checks.involuntary_stop_check(snapshots, terms, cal)
    for report in (label_bad, snapshot_bad, stop_bad):
        assert report.filter("n_bad <> 0").isEmpty()


def test_checks_find_what_is_wrong(spark, cal):
    row = ("x", "2026-01-01", None, "2026-01-10", "2026-01-09", 1)
    bad = spark.createDataFrame(
        [row], "id string, s string, e string, snap string, c string, label int"
    ).select(
        *(F.col(a).cast("date").alias(b) for a, b in (
            ("s", "term_started_at"), ("e", "term_ended_at"), ("snap", "snapshot_date"), ("c", "cancel_requested_at"))),
        "label",
    )
    found = dict(checks.run_checks(bad, checks.snapshot_checks(cal)).collect())
    assert found["non_weekly_snapshots"] == 1
    assert found["snapshot_on_or_after_cancel"] == 1
    assert found["misclassified_label_1"] == 1
    assert found["misclassified_label_0"] == 0


def literal_weeks(start, cancel, end, cal):
    """The stop rules, week by week."""
    cancel = cancel if cancel and cancel <= cal.label_cutoff else None
    for week in range(cal.max_week + 1):
        snap = start + timedelta(days=7 * week)
        horizon = snap + timedelta(days=30)
        if cancel is not None:
            keep = snap < cancel
        elif end is not None and end <= cal.label_cutoff:
            keep = horizon <= end
        else:
            keep = horizon <= cal.label_cutoff
        if keep:
            yield week, int(bool(cancel) and 1 <= (cancel - snap).days <= 30)


days = st.dates(date(2024, 6, 1), date(2026, 7, 15))


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(days, st.none() | days, st.none() | days), min_size=30, max_size=60))
def test_closed_form_equals_the_literal_weeks(spark, make_terms, cal, rows):
    text = [(f"s{i}", *(d and d.isoformat() for d in row)) for i, row in enumerate(rows)]
    bounds = labels.snapshot_bounds(make_terms(*text), cal)
    got = {(r.subscription_id, r.week_number, r.label) for r in labels.weekly_snapshots(bounds, cal).collect()}
    want = {(f"s{i}", *pair) for i, row in enumerate(rows) for pair in literal_weeks(*row, cal)}
    assert got == want
    outcomes = {(r.subscription_id, r.label) for r in labels.term_outcomes(bounds, cal).collect()}
    assert outcomes == {(s, label) for s, _, label in want}


def test_repeated_rows_of_a_large_multiplicity(spark):
    rows = spark.createDataFrame([("a", 200_000), ("b", 65_536), ("c", 1), ("d", 0)], "key string, n_rows bigint")
    got = {r["key"]: r["count"] for r in cohort.repeat_rows(rows).groupBy("key").count().collect()}
    assert got == {"a": 200_000, "b": 65_536, "c": 1}


def test_copies_of_one_row_come_from_all_tasks(spark):
    rows = spark.createDataFrame([("hot", 3_000_000), ("a", 2), ("none", 0), ("edge", 65_536)], "key string, n_rows bigint").coalesce(1)
    copies = cohort.repeat_rows(rows)
    assert {r["key"]: r["count"] for r in copies.groupBy("key").count().collect()} == {"hot": 3_000_000, "a": 2, "edge": 65_536}
    assert copies.where("key = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_wanted_plans_as_rows(spark):
    people = spark.createDataFrame([("s", False, "DAILY", 30, 10, 1), ("t", True, "DAILY", 30, 10, 1), ("u", False, "DAILY", 90, 30, 2)],
                                   "subscription_id string, is_activated boolean, current_regimen string, current_days_supply int, current_quantity int, current_drug_id int")
    plans = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, None)], "drug_id int, drug_name string")
    got = sorted((r.subscription_id, r.drug_name or "") for r in cohort.wanted_plan_rows(people, plans).collect())
    assert got == [("s", "x"), ("s", "x"), ("s", "y"), ("u", "")]


def test_visits_count_from_activation(spark, make_terms, cal):
    from tenurekit.plans import analyses

    class Study:
        calendar = cal
        cohort_terms = make_terms(("a", "2026-03-10", None, None), ("b", "2026-03-10", "2026-03-20", None))
        people = spark.createDataFrame([("a", "2026-03-01"), ("b", "2026-03-15")], "subscription_id string, day string").select(
            "subscription_id", F.to_timestamp("day").alias("activated_at"))

        @staticmethod
        def cohort_rows(_):
            visits = [("a-t", "v1", "2026-03-05"), ("a-t", "v1", "2026-03-06"), ("a-t", "v2", "2026-02-27"), ("a-t", "v3", "2026-05-01"),
                      ("b-t", "w1", "2026-03-12"), ("b-t", "w2", "2026-03-15"), ("b-t", "w3", "2026-03-21"), ("b-t", None, "2026-03-16")]
            frame = spark.createDataFrame(visits, "subscription_term_id string, visit_id string, created_at string")
            return frame.withColumn("created_at", F.to_timestamp("created_at"))

    got = {r.visit_count: (r.total_subscribers, r.cancelled_subscribers) for r in analyses()["qr_9_cancel_rate_by_visits"](Study).collect()}
    assert got == {2: (1, 0), 1: (1, 1)}
