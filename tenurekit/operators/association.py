"""Tests of association: chi-square and Mann–Whitney. They see contingency counts, not rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenurekit.functions.columns import count_where
from tenurekit.functions.tails import chi2_p_value, normal_two_sided_p
from tenurekit.operators.ordered import running_totals

ALPHA = 0.05


def chi_square(
    table: DataFrame, hit: str = "n_cancelled", n: str = "n_subscribers", by: Sequence[str] = ()
) -> DataFrame:
    """Pearson's test on a groups × (hit, not hit) table, one row per ``by`` combination.

    With one degree of freedom each deviation is first shrunk by up to a half (Yates). An empty row
    or column gives nulls.
    """
    whole = Window.partitionBy(*by)
    margins = table.select(
        *by,
        F.col(hit).cast("double").alias("hit"),
        (F.col(n) - F.col(hit)).cast("double").alias("rest"),
        F.sum(hit).over(whole).cast("double").alias("all_hit"),
        F.sum(n).over(whole).cast("double").alias("total"),
        F.count("*").over(whole).alias("n_groups"),
    )
    group_total = F.col("hit") + F.col("rest")
    empty = (group_total == 0) | (F.col("all_hit") == 0) | (F.col("all_hit") == F.col("total"))

    def cell(observed, margin):
        expected = F.try_divide(group_total * margin, F.col("total"))
        gap = F.abs(observed - expected)
        gap = F.when(F.col("n_groups") == 2, gap - F.least(gap, F.lit(0.5))).otherwise(gap)
        return F.try_divide(gap * gap, expected)

    parts = cell(F.col("hit"), F.col("all_hit")) + cell(F.col("rest"), F.col("total") - F.col("all_hit"))
    tested = margins.groupBy(*by).agg(
        F.sum(parts).alias("statistic"),
        (F.max("n_groups") - 1).alias("dof"),
        F.bool_or(F.coalesce(empty, F.lit(True))).alias("untestable"),
    )
    chi2 = F.when(~F.col("untestable"), F.col("statistic"))
    scored = tested.select(*by, chi2.alias("chi2"), "dof")
    return with_significance(scored.withColumn("p_value", chi2_p_value("chi2", "dof")))


def with_significance(tested: DataFrame) -> DataFrame:
    return tested.withColumn("significant", F.col("p_value") < ALPHA)


def candidate_tests(candidates: DataFrame) -> DataFrame:
    """Chi-square of (value > 0) against the label for every feature and look-back length at once.

    A feature that is always or never positive has no 2×2 table and gets nulls.
    """
    table = candidates.groupBy("feature", "window_days", (F.col("val") > 0).alias("positive")).agg(
        F.count("*").alias("n"), count_where(F.col("label") == 1).alias("n_label_1")
    )
    tests = chi_square(table, hit="n_label_1", n="n", by=["feature", "window_days"])
    two_by_two = F.col("dof") == 1
    return tests.withColumns({c: F.when(two_by_two, F.col(c)) for c in ("chi2", "p_value", "significant")}).drop("dof")


def best_windows(tests: DataFrame, windows: Sequence[int] = (7, 14, 30)) -> DataFrame:
    """Statistics side by side per feature, and the look-back length with the largest one.

    Compared at two decimals, as reported; the shortest length wins a tie. One grouping gives both, so the tests are run once.
    """
    rounded = tests.withColumn("chi2", F.round("chi2", 2))
    rank = F.struct(F.col("chi2"), -F.col("window_days"))
    best = F.max_by("window_days", F.when(F.col("chi2").isNotNull(), rank)).cast("string")
    by_length = (F.first(F.when(F.col("window_days") == w, F.struct("chi2")), ignorenulls=True)["chi2"].alias(f"{w}d") for w in windows)
    return rounded.where("feature IS NOT NULL").groupBy("feature").agg(*by_length, F.concat(best, F.lit("d")).alias("best_window"))


def mann_whitney(df: DataFrame, value: str, label: str = "label") -> DataFrame:
    """Two-sided U test of label 1 against label 0: tie-corrected normal form with continuity.

    Rows are counted per value; mid-ranks come from the count of smaller values.
    """
    per_value = (
        df.filter(F.col(value).isNotNull())
        .groupBy(F.col(value).alias("value"))
        .agg(count_where(F.col(label) == 1).alias("n1"), count_where(F.col(label) == 0).alias("n0"))
        .withColumn("n", F.col("n1") + F.col("n0"))
    )
    ranked = running_totals(per_value, "value", ["n"])
    mid_rank = F.col("n_before") + (F.col("n") + 1) / 2
    n = F.col("n").cast("double")
    sums = ranked.agg(
        F.sum("n1").cast("double").alias("n1"),
        F.sum("n0").cast("double").alias("n0"),
        F.sum(F.col("n1") * mid_rank).alias("rank_sum"),
        F.sum(n * n * n - n).alias("ties"),
    )
    n1, n0 = F.col("n1"), F.col("n0")
    total = n1 + n0
    u1 = F.col("rank_sum") - n1 * (n1 + 1) / 2
    variance = n1 * n0 / 12 * (total + 1 - F.try_divide(F.col("ties"), total * (total - 1)))
    larger = F.greatest(u1, n1 * n0 - u1)
    z = F.try_divide(larger - n1 * n0 / 2 - 0.5, F.sqrt(variance))
    scored = sums.select(
        n1.cast("bigint").alias("n_1"), n0.cast("bigint").alias("n_0"), u1.alias("u_statistic"),
        F.greatest(z, F.lit(0.0)).alias("z"),
    )
    return with_significance(scored.withColumn("p_value", normal_two_sided_p("z")))
