"""Textbook values and brute force for the statistics."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenurekit.functions.tails import chi2_p_value, normal_two_sided_p
from tenurekit.operators.association import best_windows, candidate_tests, chi_square, mann_whitney
from tenurekit.operators.density import box_summary, histogram, kernel_density
from tenurekit.operators.ordered import running_totals, with_previous_known
from tenurekit.operators.survival import cancel_durations, kaplan_meier


def table(spark, rows):
    return spark.createDataFrame(rows, "g string, n_subscribers bigint, n_cancelled bigint")


def test_chi_square_two_by_two_is_yates_corrected(spark):
    got = chi_square(table(spark, [("a", 30, 10), ("b", 70, 30)])).first()
    assert got.chi2 == pytest.approx(0.446429, abs=1e-6) and got.dof == 1
    assert got.p_value == pytest.approx(math.erfc(math.sqrt(0.446429 / 2)), abs=1e-6)
    assert got.significant is False


def test_chi_square_larger_table_is_plain(spark):
    rows = [("a", 30, 10), ("b", 70, 30), ("c", 50, 40)]
    got = chi_square(table(spark, rows)).first()
    observed = np.array([[k, n - k] for _, n, k in rows], float)
    expected = observed.sum(1, keepdims=True) * observed.sum(0, keepdims=True) / observed.sum()
    assert got.chi2 == pytest.approx(((observed - expected) ** 2 / expected).sum())
    assert got.dof == 2 and got.p_value == pytest.approx(math.exp(-got.chi2 / 2))


def test_chi_square_with_an_empty_margin_is_null(spark):
    got = chi_square(table(spark, [("a", 30, 0), ("b", 70, 0)])).first()
    assert got.chi2 is None and got.p_value is None and got.significant is None


@pytest.mark.parametrize(
    ("x", "dof", "want"),
    [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (18.307038, 10, 0.05), (31.410433, 20, 0.05),
     (0.0, 4, 1.0), (6.634897, 1, 0.01), (52.335618, 30, 0.007)],
)
def test_chi_square_tail(spark, x, dof, want):
    row = spark.createDataFrame([(x, dof)], "x double, k int").select(chi2_p_value("x", "k").alias("p")).first()
    assert row.p == pytest.approx(want, abs=1e-4)


def test_normal_tail(spark):
    row = spark.createDataFrame([(1.959964,)], "z double").select(normal_two_sided_p("z").alias("p")).first()
    assert row.p == pytest.approx(0.05, abs=1e-6)


def test_one_valued_candidate_has_no_test(spark):
    rows = [("f", 7, i % 2, 1) for i in range(20)] + [("g", 7, i % 2, int(i < 12)) for i in range(20)]
    df = spark.createDataFrame(rows, "feature string, window_days int, label int, val bigint")
    got = {r.feature: r for r in candidate_tests(df).collect()}
    assert got["f"].chi2 is None and got["f"].p_value is None
    assert got["g"].chi2 is not None


def test_best_window_prefers_the_shortest_on_a_tie(spark):
    rows = [("f", 7, 2.001), ("f", 14, 2.003), ("f", 30, 1.0), ("g", 7, None), ("g", 14, 1.0), ("g", 30, 3.0)]
    df = spark.createDataFrame(rows, "feature string, window_days int, chi2 double")
    got = {r.feature: r.best_window for r in best_windows(df).collect()}
    assert got == {"f": "7d", "g": "30d"}


def test_kaplan_meier_textbook(spark):
    df = spark.createDataFrame([("s", 1, 1), ("s", 2, 1), ("s", 2, 0), ("s", 3, 1), (None, 1, 1)],
                               "g string, duration_days int, event int")
    rows = kaplan_meier(df, "g").orderBy("duration_days").collect()
    assert [r.at_risk for r in rows] == [4, 3, 1]
    assert [r.survival for r in rows] == pytest.approx([0.75, 0.5, 0.0])
    assert rows[2].ci_low is None
    se = math.sqrt(1 / (4 * 3)) / math.log(0.75)
    want = [0.75 ** math.exp(s * 1.959963984540054 * se) for s in (-1, 1)]
    assert [rows[0].ci_low, rows[0].ci_high] == pytest.approx(sorted(want))


def test_same_day_later_cancel_stays_with_duration_zero(make_terms, cal):
    terms = make_terms(("a", "2026-03-01 08:00", "2026-03-01 09:00", None), ("b", "2026-03-01 08:00", "2026-03-01 08:00", None),
                       ("c", "2026-06-02", None, None))
    got = {r.subscription_id: (r.duration_days, r.event) for r in cancel_durations(terms, cal).collect()}
    assert got == {"a": (0, 1), "c": (30, 0)}


def brute_u(ones, zeros):
    return sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in ones for b in zeros)


def test_mann_whitney_small(spark):
    df = spark.createDataFrame([(v, 1) for v in (1, 2, 2)] + [(v, 0) for v in (2, 3)], "v int, label int")
    assert mann_whitney(df, "v").first().u_statistic == 1.0


def test_mann_whitney_random(spark):
    rng = random.Random(5)
    ones = [rng.choice([0.5, 1.25, 7, 90, 1e6]) for _ in range(60)]
    zeros = [rng.choice([0.5, 1.25, 7, 8, 90]) for _ in range(45)]
    df = spark.createDataFrame([(float(v), 1) for v in ones] + [(float(v), 0) for v in zeros], "v double, label int")
    got = mann_whitney(df, "v").first()
    assert got.u_statistic == brute_u(ones, zeros)
    n1, n0, n = 60, 45, 105
    ties = sum(t**3 - t for t in Counter(ones + zeros).values())
    sigma = math.sqrt(n1 * n0 / 12 * (n + 1 - ties / (n * (n - 1))))
    z = (max(got.u_statistic, n1 * n0 - got.u_statistic) - n1 * n0 / 2 - 0.5) / sigma
    assert got.p_value == pytest.approx(math.erfc(max(z, 0) / math.sqrt(2)))


def test_running_totals_match_a_plain_scan(spark):
    rng = random.Random(3)
    rows = [("a", float(v), rng.randint(1, 9)) for v in rng.sample(range(-5000, 5000), 700)] + [("b", 4.0, 2)]
    got = running_totals(spark.createDataFrame(rows, "g string, v double, n bigint"), "v", ["n"], ["g"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_before == sum(n for g, v, n in rows if g == r.g and v < r.v)
        assert r.n_total == sum(n for g, _, n in rows if g == r.g)


def test_previous_known_value_skips_nulls_across_days(spark):
    rows = [
        ("t", "2026-01-01 08:00", 1, "a"), ("t", "2026-01-01 09:00", 2, None), ("t", "2026-01-01 09:00", 3, "b"),
        ("t", "2026-01-05 00:00", 4, None), ("t", "2026-01-09 00:00", 5, "c"), ("t", None, 0, "z"), ("u", "2026-01-09 00:00", 1, "q"),
    ]
    df = spark.createDataFrame(rows, "k string, m string, i int, v string").withColumn("m", F.col("m").cast("timestamp"))
    got = {(r.k, r.i): r.previous_v for r in with_previous_known(df, "k", "m", "i", ["v"]).collect()}
    assert got == {("t", 0): None, ("t", 1): "z", ("t", 2): "a", ("t", 3): "a", ("t", 4): "b", ("t", 5): "b", ("u", 1): None}


def test_histogram_matches_numpy(spark):
    values = [0, 1, 1, 2, 5, 5, 5, 9, 10, 10]
    df = spark.createDataFrame([("a", v) for v in values] + [("flat", 3), ("flat", 3)], "g string, v int")
    rows = histogram(df, "v", "g", bins=4).orderBy("g", "bin").collect()
    density, edges = np.histogram(values, bins=4, density=True)
    assert [r.density for r in rows[:4]] == pytest.approx(list(density))
    assert [r.bin_start for r in rows[:4]] == pytest.approx(list(edges[:-1]))
    assert [r.density for r in rows[4:]] == pytest.approx(list(np.histogram([3, 3], bins=4, density=True)[0]))


def test_kernel_density_matches_the_sum_over_points(spark):
    values = [1.0, 2.0, 2.0, 3.5, 9.0]
    df = spark.createDataFrame([(v, 1) for v in values] + [(4.0, 0)], "v double, label int")
    rows = kernel_density(df, "v", points=7).orderBy("point").collect()
    h = np.std(values, ddof=1) * len(values) ** -0.2
    grid = np.linspace(min(values), max(values), 7)
    want = [sum(math.exp(-0.5 * ((x - v) / h) ** 2) for v in values) / (len(values) * h * math.sqrt(2 * math.pi)) for x in grid]
    assert {r.label for r in rows} == {1}, "a single value has no density"
    assert [r.density for r in rows] == pytest.approx(want)


def test_box_matches_numpy(spark):
    rng = random.Random(9)
    values = [rng.choice([1, 2, 3, 4, 50]) + 0.25 * rng.randint(0, 3) for _ in range(101)] + [400.0, -300.0]
    df = spark.createDataFrame([(v, 1) for v in values], "v double, label int")
    got = box_summary(df, "v").first()
    q1, median, q3 = np.percentile(values, [25, 50, 75])
    assert (got.q1, got.median, got.q3) == pytest.approx((q1, median, q3))
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = [v for v in values if low <= v <= high]
    assert (got.whisker_low, got.whisker_high) == (min(inside), max(inside))
    assert got.n_outliers == len(values) - len(inside)


def test_curve_begins_at_time_zero(spark):
    df = spark.createDataFrame([("s", 1, 1), ("s", 2, 0), ("t", 0, 1), ("t", 5, 0), (None, 1, 1)], "g string, duration_days int, event int")
    rows = kaplan_meier(df, "g", origin=True).orderBy("g", "duration_days").collect()
    assert [(r.g, r.duration_days, r.at_risk, r.n_events, r.survival) for r in rows] == [
        ("s", 0, 2, 0, 1.0), ("s", 1, 2, 1, 0.5), ("s", 2, 1, 0, 0.5), ("t", 0, 2, 1, 0.5), ("t", 5, 1, 0, 0.5)]


def test_kernel_density_of_many_distinct_values(spark):
    """Values meet only grid points near them; the sum over all points differs by less than 1e-12."""
    rng = np.random.default_rng(6)
    values = np.concatenate((rng.normal(0, 1, 4000), rng.normal(40, 0.1, 1000)))
    df = spark.createDataFrame([(float(v), 1) for v in values], "v double, label int")
    rows = kernel_density(df, "v", points=60).orderBy("point").collect()
    h = np.std(values, ddof=1) * len(values) ** -0.2
    grid = np.linspace(values.min(), values.max(), 60)
    want = np.exp(-(((grid[:, None] - values) / h) ** 2) / 2).sum(axis=1) / (len(values) * h * math.sqrt(2 * math.pi))
    assert len(rows) == 60 and np.abs(np.array([r.density for r in rows]) - want).max() < 1e-12
