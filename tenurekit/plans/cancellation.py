"""Voluntary against involuntary cancellation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenurekit.functions.buckets import dose_group, strength_group
from tenurekit.functions.columns import as_date, count_where, days_between, is_false, ratio
from tenurekit.operators import summaries as sm
from tenurekit.operators.cohort import SUB, TERM, restrict_to
from tenurekit.operators.density import histogram
from tenurekit.operators.lookback import CANCELED
from tenurekit.plans.registry import named
from tenurekit.plans.sanity import cohort_size
from tenurekit.sources.tables import distinct_values

KIND, FAILED_FLAG = "cancellation_type", "is_failed_payment_canceled"
VOLUNTARY, INVOLUNTARY = "voluntary_cancellation", "involuntary_cancellation"


@named("q03_1_refined_cohort_size")
def _(lake):
    return cohort_size(lake.refined)


@named("q03_2_cancellation_type")
def _(lake):
    return lake.typed.select(SUB, TERM, "term_started_at", "term_ended_at", "cancel_requested_at", KIND)


@named("q03_3_type_share")
def _(lake):
    return sm.share(lake.typed, [KIND], distinct=SUB).orderBy(F.desc("n"))


@named("q03_4_failed_payment_flags")
def _(lake):
    return distinct_values(lake.terms, FAILED_FLAG)


def _failed_charges_by_attempt(lake):
    """Subscriptions with an unpaid charge, by attempt. Charges meet the cohort as they lie; what is left is dealt into small
    pieces, each of which folds to distinct attempts per subscription in little memory and counts them as plain rows."""
    by = ["attempt_number", "attempts_remaining"]
    unpaid = lake.cohort_rows("subscription_charges").filter(is_false("was_paid"))
    rows = restrict_to(unpaid.select(SUB, *by), lake.typed, hashed=True)
    pieces = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # said here, so that AQE does not merge them
    return sm.counts(rows.repartition(pieces, SUB, *by).distinct(), by, n="n_subs").orderBy("attempt_number")


named("q03_5_failed_charges_by_attempt_first_copy")(_failed_charges_by_attempt)
named("q03_7_failed_charges_by_attempt")(_failed_charges_by_attempt)


@named("q03_6_null_flag_by_termination_type")
def _(lake):
    rows = lake.typed.filter(F.col(FAILED_FLAG).isNull())
    by = [FAILED_FLAG, "termination_type"]
    return sm.counts(rows, by, distinct=SUB, n="n_subs").orderBy(F.desc(FAILED_FLAG), F.desc("n_subs"))


def _involuntary(lake):
    return lake.typed.filter(F.col(KIND) == INVOLUNTARY)


def _with_canceller(lake, rows):
    """Who cancelled, where a cancel event exists; unmatched rows stay."""
    cancels = lake.cohort_events.filter(F.col("event_name") == CANCELED).select(SUB, "changed_by").distinct()
    return rows.join(cancels, SUB, "left")


@named("q03_8_all_attempts_failed")
def _(lake):
    unpaid = lake.cohort_rows("subscription_charges").filter(is_false("was_paid") & (F.col("attempt_number") == 8))
    exhausted = _involuntary(lake).join(unpaid.select(SUB).distinct(), SUB, "left_semi")
    by = [FAILED_FLAG, "termination_type", "changed_by"]
    return sm.counts(_with_canceller(lake, exhausted), by, distinct=SUB, n="n_subs").orderBy(F.desc("n_subs"))


@named("q03_9_involuntary_by_flag")
def _(lake):
    return sm.share(_involuntary(lake), [FAILED_FLAG], distinct=SUB, n="n_subs").orderBy(F.desc("n_subs"))


@named("q03_10_involuntary_by_flag_and_termination")
def _(lake):
    by = [FAILED_FLAG, "termination_type"]
    return sm.share(_involuntary(lake), by, distinct=SUB, n="n_subs").orderBy(F.desc("n_subs"))


@named("q03_11_involuntary_not_payment_by_canceller")
def _(lake):
    unexplained = _involuntary(lake).filter(is_false(FAILED_FLAG))
    by = ["termination_type", "changed_by"]
    return sm.counts(_with_canceller(lake, unexplained), by, distinct=SUB, n="n_subs").orderBy(F.desc("n_subs"))


@named("q03_12_valid_cohort_size")
def _(lake):
    return lake.valid.groupBy(KIND).agg(
        F.sum("n_rows").alias("n_rows"), F.count_distinct(SUB).alias("n_subscriptions")
    )


def _type_mix(attribute, name):
    def analysis(lake):
        rows = lake.valid.select(SUB, TERM, KIND).join(lake.latest_plan(attribute().alias(name)), TERM)
        mix = sm.share(rows, [KIND, name], distinct=SUB, within=[KIND], name="pct_within_type")
        return mix.orderBy(KIND, F.desc("n"))

    return analysis


for _name, _alias, _attribute in (
    ("q03_13_type_by_cadence", "cadence", lambda: F.col("term_months")),
    ("q03_14_type_by_drug", "drug_name", lambda: F.col("drug_name")),
    ("q03_15_type_by_regimen", "regimen", lambda: F.col("regimen")),
    ("q03_16_type_by_strength_group", "strength_group", lambda: strength_group("drug_strength")),
    ("q03_17_type_by_dose_group", "dose_group", lambda: dose_group("monthly_dose")),
):
    named(_name)(_type_mix(_attribute, _alias))


@named("q03_18_payment_behaviour")
def _(lake):
    """Averages over invoices, weighted by how often the valid cohort repeats a row. Invoices fold
    to one row per term before the join."""
    per_term = (
        lake.cohort_rows("subscription_invoices")
        .groupBy(TERM)
        .agg(
            F.count("*").alias("invoices"),
            F.sum("num_charges").alias("charges"),
            F.count("num_charges").alias("with_charges"),
            count_where(F.col("is_failed")).alias("failed"),
            count_where(F.col("is_delinquent")).alias("delinquent"),
        )
    )
    measures = ("invoices", "charges", "with_charges", "failed", "delinquent")
    rows = lake.valid.select(SUB, TERM, KIND, "n_rows").join(per_term, TERM)
    sums = rows.groupBy(KIND).agg(
        *(F.sum(F.col(m) * F.col("n_rows")).alias(m) for m in measures), F.count_distinct(SUB).alias("n")
    )
    return sums.select(
        KIND,
        ratio("charges", "with_charges", 2).alias("avg_num_charges"),
        ratio("failed", "invoices", 3).alias("avg_failure_rate"),
        ratio("delinquent", "invoices", 3).alias("avg_delinquency_rate"),
        "n",
    ).orderBy(KIND)


def _days_to_cancellation(lake):
    rows = lake.valid.filter(F.col(KIND).isin(VOLUNTARY, INVOLUNTARY))
    until = F.coalesce(as_date("cancel_requested_at"), as_date("term_ended_at"))
    return rows.select(KIND, days_between("term_started_at", until).alias("days_to_cancellation"), "n_rows")


@named("q03_19_days_to_cancellation")
def _(lake):
    return sm.counts(_days_to_cancellation(lake), [KIND, "days_to_cancellation"], weight="n_rows")


@named("st7_days_to_cancellation_histogram")
def _(lake):
    bars = histogram(_days_to_cancellation(lake), "days_to_cancellation", KIND, bins=60, weight="n_rows")
    return bars.withColumns({c: F.round(c, 6) for c in ("bin_start", "bin_end", "density")})


@named("q03_20_label_by_type")
def _(lake):
    labels = lake.labels.select(TERM, "cancel_status")
    rows = lake.valid.select(SUB, TERM, KIND).join(labels, TERM)
    return sm.share(rows, ["cancel_status", KIND], distinct=SUB).orderBy("cancel_status", KIND)
