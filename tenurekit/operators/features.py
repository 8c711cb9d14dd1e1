"""Snapshot features: weekly series, per-snapshot values, window candidates and the gold table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenurekit.config import Calendar
from tenurekit.functions.buckets import channel_group, dose_group, strength_group
from tenurekit.functions.columns import as_date, count_where, days_between, mean
from tenurekit.operators.cohort import SUB, TERM, join_split, latest_plan
from tenurekit.operators.labels import term_outcomes, with_snapshot
from tenurekit.operators.lookback import (
    BY_USER,
    REMINDER_SENT,
    RENEWAL_MOVED,
    by_day,
    changed,
    event_days,
    folded_shapes,
    invoice_days,
    over_weeks,
    reminders,
    spread_over_snapshots,
    up_to_week,
    user_deferrals,
    with_outcome,
)
from tenurekit.operators.ordered import with_previous_known

PLAN_ATTRIBUTES = {
    "drug_change": "drug_name",
    "regimen_change": "regimen",
    "strength_change": "drug_strength",
    "dose_change": "monthly_dose",
    "fulfillment_change": "starting_fulfillment_type",
}
WEEK = ("week_number", "group")


def _total(name: str, condition: Column | None = None) -> Column:
    value = F.col(name) if condition is None else F.when(condition, F.col(name))
    return F.coalesce(F.sum(value), F.lit(0)).alias(name)


# ---------------------------------------------------------------- weekly series


def invoice_series(invoices: DataFrame, bounds: DataFrame, cal: Calendar, window: int, max_week: int | None) -> DataFrame:
    """Per week and outcome, over the invoices of each snapshot's window: failure, delinquency and
    refund rates, charges per invoice, and fills and refills per invoice day."""
    bounds = up_to_week(bounds, max_week)
    rows = with_outcome(spread_over_snapshots(invoice_days(invoices), bounds, TERM, cal, window))
    sums = rows.groupBy(*WEEK).agg(
        F.count("*").alias("n_days"),
        *(_total(c) for c in ("n", "failed", "delinquent", "paid", "refunded", "charges", "n_charges")),
        F.sum(F.greatest(F.col("paid") - 1, F.lit(0))).alias("refills"),
    )
    return sums.select(
        *WEEK,
        mean("failed", "n").alias("failure_rate"),
        mean("delinquent", "n").alias("delinquency_rate"),
        mean("refunded", "n").alias("refund_rate"),
        mean("charges", "n_charges").alias("avg_charges"),
        mean("paid", "n_days").alias("avg_fills"),
        mean("refills", "n_days").alias("avg_refills"),
    )


def event_series(events: DataFrame, bounds: DataFrame, cal: Calendar, window: int, max_week: int | None) -> DataFrame:
    """Per week and outcome: share of rows with an event, and events and days deferred per row.

    A snapshot contributes one row per event day in its window, and one empty row when it has none. Terms of one subscription
    that share start, last week and cancel are one shape with a count, so days never meet equal terms one by one. Only
    matched snapshots are shuffled; the empty ones follow from the count of all snapshots.
    """
    shapes = folded_shapes(up_to_week(bounds, max_week))
    hits = with_outcome(spread_over_snapshots(event_days(events), shapes, SUB, cal, window))
    shape = (SUB, "term_started_at", "cancel_requested_at", "n_terms")
    per_snapshot = hits.groupBy(*shape, *WEEK).agg(F.count("*").alias("matched"), _total("n"), _total("days_deferred"))
    matched = per_snapshot.groupBy(*WEEK).agg(
        *(F.coalesce(F.sum(F.col(c) * F.col("n_terms")), F.lit(0)).alias(c) for c in ("matched", "n", "days_deferred")),
        (-F.sum("n_terms")).alias("empty"),
    )
    zero = F.lit(0).cast("bigint")
    weeks = F.explode(F.sequence(F.lit(0), F.col("last_week")))
    everyone = (
        with_outcome(with_snapshot(shapes.withColumn("week_number", weeks), cal))
        .groupBy(*WEEK)
        .agg(F.sum("n_terms").alias("empty"))
        .select(*WEEK, zero.alias("matched"), zero.alias("n"), zero.alias("days_deferred"), "empty")
    )
    sums = matched.unionByName(everyone).groupBy(*WEEK).agg(
        *(_total(c) for c in ("matched", "n", "days_deferred", "empty"))
    )
    rows = F.col("matched") + F.col("empty")
    return sums.select(
        *WEEK,
        mean("matched", rows).alias("has_event"),
        mean("n", rows).alias("avg_events"),
        mean("days_deferred", rows).alias("avg_days_deferred"),
    )


def deferral_series(events: DataFrame, bounds: DataFrame, cal: Calendar, window: int, max_week: int | None) -> DataFrame:
    series = event_series(user_deferrals(events, with_both_dates=True), bounds, cal, window, max_week)
    return series.withColumnsRenamed({"has_event": "has_deferred", "avg_events": "avg_num_deferrals"})


def reminder_series(events: DataFrame, bounds: DataFrame, cal: Calendar, window: int, max_week: int | None) -> DataFrame:
    series = event_series(reminders(events), bounds, cal, window, max_week)
    return series.withColumnsRenamed({"has_event": "has_reminder", "avg_events": "avg_reminders"}).drop(
        "avg_days_deferred"
    )


def plan_steps(plan_terms: DataFrame) -> DataFrame:
    """What reports read of plan terms."""
    return plan_terms.select(TERM, "plan_term_number", "plan_term_started_at", "is_latest_plan_term", "term_months", *PLAN_ATTRIBUTES.values())


def plan_days(plan_terms: DataFrame) -> DataFrame:
    """Plan starts per term and day, with how many changed what against the plan before."""
    attributes = list(PLAN_ATTRIBUTES.values())
    needed = plan_terms.select(TERM, "plan_term_number", "plan_term_started_at", *attributes)
    known = with_previous_known(needed, TERM, "plan_term_started_at", "plan_term_number", attributes)
    return by_day(
        known,
        TERM,
        "plan_term_started_at",
        has_plan_change=count_where(F.col("plan_term_number") > 1),
        **{name: F.sum(changed(column)) for name, column in PLAN_ATTRIBUTES.items()},
    )


def plan_change_series(
    plan_terms: DataFrame, bounds: DataFrame, cal: Calendar, window: int, max_week: int | None
) -> DataFrame:
    """Per week and outcome: share of plan starts in the window that were a change, by kind."""
    bounds = up_to_week(bounds, max_week)
    rows = with_outcome(spread_over_snapshots(plan_days(plan_terms), bounds, TERM, cal, window))
    kinds = ["has_plan_change", *PLAN_ATTRIBUTES]
    sums = rows.groupBy(*WEEK).agg(_total("n"), *(_total(k) for k in kinds))
    return sums.select(*WEEK, *(mean(k, "n").alias(k) for k in kinds))


# ---------------------------------------------------------------- per snapshot and static


def fills_per_snapshot(invoices: DataFrame, bounds: DataFrame, cal: Calendar, window: int) -> DataFrame:
    """Paid invoices in the window, for snapshots that have any invoice in it."""
    rows = spread_over_snapshots(invoice_days(invoices), bounds, TERM, cal, window)
    return rows.groupBy(SUB, "snapshot_date", "label").agg(F.sum("paid").alias("num_fills"))


def days_deferred_per_snapshot(
    events: DataFrame, bounds: DataFrame, cal: Calendar, window: int, keep_zero: bool = True
) -> DataFrame:
    """Days deferred in the window; ``keep_zero=False`` leaves out snapshots without a deferral
    before anything is shuffled.

    With ``keep_zero`` each shape brings one row without a day, which goes to all its snapshots. Rows are brought together by
    subscription before they are spread over weeks, in many small partitions, and summed where they lie.
    """
    keys = [SUB, "snapshot_date", "label"]
    daily = event_days(user_deferrals(events, with_both_dates=True))
    shapes = folded_shapes(bounds)
    deferred = (F.col("days_deferred") * F.col("n_terms")).alias("days_deferred")
    if not keep_zero:
        rows = spread_over_snapshots(daily, shapes, SUB, cal, window).select(*keys, deferred)
    else:
        empty = shapes.select("*", F.lit(None).cast("date").alias("day"), F.lit(0).cast("bigint").alias("days_deferred"))
        dated = join_split(daily, shapes, SUB).select(*empty.columns).unionByName(empty)
        pieces = 8 * int(bounds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = over_weeks(dated.repartition(pieces, SUB), cal, window).select(*keys, deferred)
    return rows.groupBy(*keys).agg(F.sum("days_deferred").alias("total_days_deferred"))


def static_profile(bounds: DataFrame, plan_terms: DataFrame, subscriptions: DataFrame, cal: Calendar) -> DataFrame:
    """Distinct subscriptions by strength, dose, regimen, channel and outcome.

    A term enters with its (at most two) outcomes, not with its snapshots.
    """
    outcomes = with_outcome(term_outcomes(bounds, cal)).drop("label")
    plans = latest_plan(
        plan_terms,
        strength_group("drug_strength").alias("strength_group"),
        dose_group("monthly_dose").alias("dose_group"),
        "regimen",
    )
    channels = subscriptions.select(SUB, channel_group("first_channel_grouping").alias("channel_group"))
    return (
        outcomes.join(plans, TERM)
        .join(channels, SUB)
        .groupBy("strength_group", "dose_group", "regimen", "channel_group", "group")
        .agg(F.count_distinct(SUB).alias("n"))
    )


def failed_invoices_at_start(invoices: DataFrame, labels: DataFrame) -> DataFrame:
    """Failed invoices per term among those fully known at its start date (midnight).

    A row is known from the first midnight not before its creation and, if it failed, its failure.
    Counting per (term, that day) first keeps a hot term small in the join.
    """

    def midnight_after(moment: str) -> Column:
        day = as_date(moment)
        return F.when(F.col(moment) > day, F.date_add(day, 1)).otherwise(day)

    known = F.greatest(midnight_after("created_at"), midnight_after("failed_at"))
    per_day = (
        invoices.filter(F.col("created_at").isNotNull())
        .groupBy(TERM, known.alias("known_day"))
        .agg(count_where(F.col("is_failed")).alias("failed"))
    )
    starts = labels.select(TERM, "term_started_at")
    return (
        per_day.join(starts, TERM)
        .filter(F.col("known_day") <= F.col("term_started_at"))
        .groupBy(TERM)
        .agg(F.sum("failed").alias("failed_invoice_count"))
    )


# ---------------------------------------------------------------- window candidates


def _long_form(wide: DataFrame, cells: Sequence[tuple[str, int, str, str | None, bool]]) -> DataFrame:
    """``(feature, window, total, presence, binary)`` columns of a wide row as rows."""
    entries = [
        F.struct(
            F.lit(feature).alias("feature"),
            F.lit(window).alias("window_days"),
            (F.col(present) > 0 if present else F.lit(True)).alias("present"),
            (F.least(F.col(total), F.lit(1)) if binary else F.col(total)).cast("bigint").alias("val"),
        )
        for feature, window, total, present, binary in cells
    ]
    return (
        wide.select(SUB, "label", F.explode(F.array(*entries)).alias("cell"))
        .select(SUB, "label", "cell.*")
        .filter("present")
        .drop("present")
    )


def window_candidates(
    profile: DataFrame, days: DataFrame, cal: Calendar, windows: Sequence[int] = (7, 14, 30)
) -> DataFrame:
    """Eight features at each look-back length: (feature, window_days, subscription, label, val).

    One pass over the activity of all sources covers all features and lengths. Invoice and plan features exist only where
    the window holds a row; event features exist for every (subscription, label) and are 0 without an event.
    """
    totals = ("invoices", "failed", "delinquent", "paid", "refunded", "charges", "deferrals", "reminders", "plan_starts", "plan_changes")
    rows = over_weeks(days.join(profile, TERM), cal, max(windows))
    folded = rows.groupBy(SUB, "label").agg(
        *(F.sum(F.when(F.col("age_days") <= w, F.col(c)).otherwise(0)).alias(f"{c}_{w}") for c in totals for w in windows)
    )
    features = (
        ("invoice_failure", "failed", "invoices", True),
        ("delinquency", "delinquent", "invoices", True),
        ("num_fills", "paid", "invoices", False),
        ("refund_count", "refunded", "invoices", False),
        ("num_charges", "charges", "invoices", False),
        ("has_deferral", "deferrals", None, True),
        ("refill_reminder", "reminders", None, True),
        ("has_plan_change", "plan_changes", "plan_starts", True),
    )
    return _long_form(folded, [(f, w, f"{c}_{w}", present and f"{present}_{w}", b) for f, c, present, b in features for w in windows])


# ---------------------------------------------------------------- gold

PLAN_AS_OF = ("term_months", "drug_name", "regimen")


def plan_at_snapshots(
    bounds: DataFrame, plan_terms: DataFrame, cal: Calendar, attributes: Sequence[str] = PLAN_AS_OF
) -> DataFrame:
    """Per term and snapshot, the plan current on it: the last one started by that day, or nulls.

    Plans are folded to the last one per day, then per week, so a term's list is never longer than
    its snapshots; it is looked up on the term's single row, before the snapshots fan out.
    """
    order = F.struct("plan_term_started_at", "plan_term_number")
    per_day = (
        plan_terms.filter(F.col("plan_term_started_at").isNotNull())
        .groupBy(TERM, as_date("plan_term_started_at").alias("day"))
        .agg(F.max_by(F.struct(*attributes), order).alias("plan"))
    )
    since = F.greatest(F.lit(0), F.ceil(F.datediff("day", "term_started_at") / cal.step_days).cast("int"))
    periods = (
        per_day.join(bounds.select(TERM, "term_started_at", "last_week"), TERM)
        .withColumn("first_week", since)
        .filter(F.col("first_week") <= F.col("last_week"))
        .groupBy(TERM, "first_week")
        .agg(F.max_by("plan", "day").alias("plan"))
        .groupBy(TERM)
        .agg(F.sort_array(F.collect_list(F.struct("first_week", "plan"))).alias("periods"))
    )

    def entry(week: Column) -> Column:
        so_far = F.filter("periods", lambda period: period["first_week"] <= week)
        return F.struct(week.alias("week_number"), F.try_element_at(so_far, F.lit(-1))["plan"].alias("plan"))

    entries = F.explode(F.transform(F.sequence(F.lit(0), F.col("last_week")), entry)).alias("entry")
    listed = bounds.join(periods, TERM, "left").select(SUB, TERM, "term_started_at", entries)
    week = F.col("entry.week_number")
    return listed.select(
        SUB,
        TERM,
        week.alias("week_number"),
        F.date_add("term_started_at", week * cal.step_days).alias("snapshot_date"),
        *(F.col(f"entry.plan.{a}").alias(a) for a in attributes),
    )


ACTIVITY = (
    "invoices", "failed", "paid", "refunded", "delinquent", "charges", "deferrals", "days_deferred", "reminders", "plan_starts", "plan_changes",
)
KNOWN_FROM = {"paid": "paid_at", "failed": "failed_at", "refunded": "refunded_at"}


PROFILE = ("first_platform", "channel_group")


def profile_columns(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.withColumn("channel_group", channel_group("first_channel_grouping"))


def term_profile(bounds: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Bounds with what never changes about their subscription. Terms of unknown subscriptions drop out."""
    return join_split(bounds, profile_columns(subscriptions).select(SUB, *PROFILE), SUB)


def activity_days(
    bounds: DataFrame, invoices: DataFrame, events: DataFrame, plan_terms: DataFrame, cal: Calendar
) -> DataFrame:
    """Daily counts of every source by term: one row per (term, day) and source, and one empty row without a day per term.

    Invoices are kept apart by the days on which a payment, failure or refund became known. Events belong to all terms of
    their subscription that still have snapshots; days after a term's last one are left out.
    """
    known = [as_date(moment).alias(f"{c}_day") for c, moment in KNOWN_FROM.items()]
    zero = F.lit(0).cast("bigint")

    def shaped(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
        dated = [F.col(f"{c}_day") if f"{c}_day" in rows.columns else F.lit(None).cast("date").alias(f"{c}_day") for c in KNOWN_FROM]
        values = [(F.coalesce(F.col(columns[c]).cast("bigint"), zero) if c in columns else zero).alias(c) for c in ACTIVITY]
        return rows.select(TERM, "day", *dated, *values)

    is_deferral = (F.col("event_name") == RENEWAL_MOVED) & (F.col("changed_by") == BY_USER)
    is_reminder = F.col("event_name") == REMINDER_SENT
    moved = days_between("old_renewal_at", "new_renewal_at")
    of_subscription = by_day(
        events.filter(is_deferral | is_reminder),
        SUB,
        "occurred_at",
        deferrals=count_where(is_deferral),
        days_deferred=F.sum(F.when(is_deferral, moved)),
        reminders=count_where(is_reminder),
    )
    dated_terms = bounds.select(SUB, TERM, F.date_add("term_started_at", F.col("last_week") * cal.step_days).alias("_last_day"))
    of_terms = join_split(of_subscription, dated_terms, SUB).filter(F.col("day") <= F.col("_last_day"))
    plans = by_day(plan_terms, TERM, "plan_term_started_at", later=count_where(F.col("plan_term_number") > 1))
    parts = [
        shaped(invoice_days(invoices, *known), {"invoices": "n"} | {c: c for c in ("failed", "paid", "refunded", "delinquent", "charges")}),
        shaped(of_terms, {c: c for c in ("deferrals", "days_deferred", "reminders")}),
        shaped(plans, {"plan_starts": "n", "plan_changes": "later"}),
        shaped(bounds.select(TERM, F.lit(None).cast("date").alias("day")), {}),
    ]
    return reduce(DataFrame.unionByName, parts)


def snapshot_feature_table(
    profile: DataFrame, days: DataFrame, cal: Calendar, windows: Sequence[int] = (7, 14, 30), strict: bool = False
) -> DataFrame:
    """One row per term and snapshot: look-back counts no later than the snapshot, and the label.

    A single pass: a term's daily rows meet its bounds once, each day goes to the few snapshots whose longest window holds
    it, the term's empty row to all of them, and one aggregate by term and week counts every length. Where both inputs are
    stored by term nothing is exchanged.

    Invoice flags are current states. ``strict=True`` counts a payment, failure or refund only once
    its own date has come, and leaves out delinquency and charge counts, which carry no date.
    """
    names = [c for c in ACTIVITY if not (strict and c in ("delinquent", "charges"))]
    rows = over_weeks(days.join(profile, TERM), cal, max(windows))

    def counted(name: str, window: int) -> Column:
        inside = F.col("age_days") <= window
        if strict and name in KNOWN_FROM:
            inside &= F.col(f"{name}_day") <= F.col("snapshot_date")
        return F.sum(F.when(inside, F.col(name)).otherwise(0)).alias(f"{name}_{window}d")

    features = [f"{c}_{w}d" for c in names for w in windows]
    snapshot = (SUB, TERM, "snapshot_date", "week_number", "first_platform", "channel_group", "label")
    sums = rows.groupBy(*snapshot).agg(*(counted(c, w) for c in names for w in windows))
    return sums.select(
        SUB,
        TERM,
        "snapshot_date",
        "week_number",
        (F.col("week_number") * cal.step_days).alias("days_since_term_start"),
        "first_platform",
        "channel_group",
        *features,
        "label",
    )
