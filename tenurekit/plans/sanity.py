"""Integrity of the cohort, the labels and the snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenurekit.functions.buckets import subscriber_type
from tenurekit.functions.columns import is_true, percent
from tenurekit.operators import checks
from tenurekit.operators import summaries as sm
from tenurekit.operators.cohort import SUB, TERM, restrict_to
from tenurekit.operators.conform import with_cancel_before_cutoff
from tenurekit.plans.registry import named

EXAMPLE_SUBSCRIPTION = 1


def refined_with_flag(lake):
    return with_cancel_before_cutoff(lake.refined_terms, lake.calendar)


def cohort_size(rows):
    """Rows and distinct subscriptions, through one count per subscription."""
    per_sub = rows.groupBy(SUB).agg(F.count("*").alias("n"))
    return per_sub.agg(F.sum("n").alias("total_terms"), F.count("*").alias("unique_subscriptions"))


@named("q00_1_cohort_size")
def _(lake):
    return cohort_size(lake.qualified)


@named("q00_2_several_qualified_terms")
def _(lake):
    per_sub = lake.qualified.groupBy(SUB).agg(F.count_distinct(TERM).alias("unique_terms"))
    return per_sub.filter(F.col("unique_terms") > 1)


@named("q00_3_terms_of_one_subscription")
def _(lake):
    return lake.all_terms.filter(F.col(SUB) == EXAMPLE_SUBSCRIPTION)


@named("q00_4_timeline_of_one_subscription")
def _(lake):
    rows = lake.events.filter(F.col(SUB) == EXAMPLE_SUBSCRIPTION)
    return rows.select("raw_occurred_at", "occurred_at", "event_name", "old_renewal_at", "new_renewal_at").orderBy(
        "raw_occurred_at"
    )


@named("q00_5_cohort_against_all_terms")
def _(lake):
    """Distinct terms on both sides, each side counted on its own after a semi-join."""
    first = lake.all_terms.filter(F.col("term_number") == 1)
    mine = restrict_to(lake.qualified, first).select(F.lit("mine").alias("side"), TERM)
    theirs = restrict_to(first, lake.qualified).select(F.lit("theirs").alias("side"), TERM)
    sides = mine.unionByName(theirs).distinct()
    return sides.agg(
        F.count_if(F.col("side") == "mine").alias("n_terms_in_qualified"),
        F.count_if(F.col("side") == "theirs").alias("n_terms_in_all_terms"),
    )


@named("q00_6_several_first_terms")
def _(lake):
    first = lake.all_terms.filter(F.col("term_number") == 1)
    per_sub = first.groupBy(SUB).agg(F.count_distinct(TERM).alias("n_first_term"))
    return per_sub.filter(F.col("n_first_term") > 1)


@named("q00_7_refined_cohort_size")
def _(lake):
    return cohort_size(lake.refined)


@named("q00_8_cancel_status_share")
def _(lake):
    return sm.share(refined_with_flag(lake), ["cancel_status_before_cutoff"], places=2).orderBy(F.desc("n"))


@named("q00_9_cancel_status_by_term_status")
def _(lake):
    by = ["cancel_status_before_cutoff", "term_status"]
    return sm.counts(refined_with_flag(lake), by).orderBy(by[0], F.desc("n"))


def _cancelled_but_active(lake):
    rows = refined_with_flag(lake)
    return rows.filter((F.col("cancel_status_before_cutoff") == "cancelled") & (F.col("term_status") == "active"))


@named("q00_10_cancelled_not_ended")
def _(lake):
    open_ended = _cancelled_but_active(lake).filter(F.col("term_ended_at").isNull())
    return open_ended.agg(F.count_distinct(SUB).alias("n_not_ended_yet"))


@named("q00_11_cancelled_active_but_ended")
def _(lake):
    ended = _cancelled_but_active(lake).filter(F.col("term_ended_at").isNotNull())
    return ended.select(SUB, TERM, "term_number", "term_started_at", "term_ended_at", "cancel_requested_at")


@named("q00_12_starts_per_month")
def _(lake):
    months = sm.period_counts(lake.refined_terms, "term_started_at", "month", "term_start_month")
    return months.orderBy(F.desc("term_start_month"))


@named("q00_13_cancels_per_week")
def _(lake):
    cancelled = refined_with_flag(lake).filter(is_true("is_cancelled_before_cutoff"))
    return sm.period_counts(cancelled, "cancel_requested_at", "week", "cancel_week").orderBy("cancel_week")


@named("q00_14_duplicate_terms")
def _(lake):
    per_term = lake.refined.groupBy(TERM).agg(F.count("*").alias("n"))
    return per_term.agg(F.sum("n").alias("total_rows"), F.count("*").alias("unique_terms"))


@named("q00_15_labelled_overall")
def _(lake):
    """Two distinct counts, taken as plain counts over one row per term."""
    cohort = lake.refined.select(TERM).distinct()
    labelled = lake.all_terms.filter(F.col("is_cancelled_before_cutoff").isNotNull())
    found = cohort.join(labelled.select(TERM, F.lit(1).alias("found")).distinct(), TERM, "left")
    sizes = found.agg(F.count("*").alias("cohort_size"), F.count("found").alias("labeled"))
    return sizes.withColumn("missing_labels", F.col("cohort_size") - F.col("labeled"))


@named("q00_16_labelled_30_days")
def _(lake):
    found = lake.refined.join(lake.labels.select(TERM, F.lit(1).alias("found")), TERM, "left")
    sizes = found.agg(F.count(TERM).alias("cohort_size"), F.count("found").alias("labeled"))
    return sizes.withColumn("missing_labels", F.col("cohort_size") - F.col("labeled"))


@named("q00_17_several_latest_plans")
def _(lake):
    latest = lake.plan_terms.filter(F.col("is_latest_plan_term"))
    per_sub = latest.groupBy(SUB).agg(F.count_distinct(TERM).alias("n_latest_terms"))
    return per_sub.filter(F.col("n_latest_terms") > 1)


@named("q00_17_latest_plans_per_term")
def _(lake):
    """Terms with several latest plans: none, or joins to the latest plan repeat rows."""
    latest = lake.source["subscription_plan_terms"].filter(F.col("is_latest_plan_term"))
    per_term = latest.groupBy(TERM).agg(F.count("*").alias("n"))
    return checks.run_checks(per_term, {"terms_with_several_latest_plans": F.col("n") > 1})


@named("q00_18_plans_of_one_subscription")
def _(lake):
    rows = lake.plan_terms.filter(F.col(SUB) == EXAMPLE_SUBSCRIPTION)
    return rows.select(SUB, TERM, "subscription_plan_term_id", "term_number", "is_latest_plan_term")


@named("q00_19_plans_of_fell_out")
def _(lake):
    fell_out = lake.people.filter(~F.col("is_activated")).select(SUB)
    rows = lake.source["subscription_plan_terms"].join(fell_out, SUB, "left_semi")
    return rows.select(SUB, TERM, "subscription_plan_term_id", "plan_term_number", "drug_name", "term_months")


@named("q00_20_to_25_label_checks")
def _(lake):
    return checks.run_checks(lake.labels, checks.label_checks(lake.calendar))


@named("q00_26_sample_cancelled")
def _(lake):
    """Ten rows to look at, in a fixed order."""
    columns = ["cancel_status", "term_started_at", "day_1_after_start", "day_30_after_start", "cancel_requested_at"]
    rows = lake.labels.filter(F.col("cancel_status") != "not_cancelled").select(*columns)
    return rows.orderBy("term_started_at", "cancel_requested_at", "cancel_status").limit(10)


@named("q00_27_snapshot_duplicates")
def _(lake):
    return checks.snapshot_duplicates(lake.snapshots)


@named("q00_28_to_33_snapshot_checks")
def _(lake):
    return checks.run_checks(lake.snapshots, checks.snapshot_checks(lake.calendar))


@named("q00_34_label_rate_by_week")
def _(lake):
    weeks = lake.snapshots.groupBy("week_number").agg(
        F.count("*").alias("n_snapshots"), F.sum("label").alias("n_label_1")
    )
    return weeks.withColumn("label_rate_pct", percent("n_label_1", "n_snapshots", 1)).orderBy("week_number")


@named("q00_35_involuntary_stop_rule")
def _(lake):
    return checks.involuntary_stop_check(lake.snapshots, lake.terms, lake.calendar)


@named("q00_36_subscriber_types")
def _(lake):
    kind = subscriber_type("cancel_requested_at", "term_ended_at")
    per_sub = (
        lake.snapshots.groupBy(kind.alias("subscriber_type"), SUB)
        .agg(F.count("*").alias("n"), F.sum("label").alias("labels"))
    )
    return per_sub.groupBy("subscriber_type").agg(
        F.count("*").alias("n_subscribers"), F.sum("n").alias("n_snapshots"), F.sum("labels").alias("n_label_1")
    )
