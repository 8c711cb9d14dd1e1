"""Who is studied: activated first terms, and the narrower cohorts built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenurekit.config import Calendar
from tenurekit.functions.buckets import cadence_months, cancellation_type
from tenurekit.functions.columns import day, is_false

SUB, TERM = "subscription_id", "subscription_term_id"


def join_split(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on a key that may own a large share of the rows of either side.

    The key's hash joins along, so that both sides are exchanged right below this join even where one of them already
    lies by the key. AQE splits a hot key only between two such exchanges.
    """
    hashed = (side.withColumn("_hash", F.xxhash64(key)) for side in (left, right))
    return next(hashed).join(next(hashed), [key, "_hash"], how).drop("_hash")


def cohort_terms(terms: DataFrame, subscriptions: DataFrame, cal: Calendar, carry: Sequence[str] = ()) -> DataFrame:
    """Term rows of the qualified cohort, all columns kept.

    Carrying the columns here saves every later step from joining the cohort back to the terms. ``carry`` names columns of
    the subscription to bring along (a subscription that is listed twice then counts twice).
    """
    eligible = subscriptions.filter(F.col("is_paid") & F.col("is_activated")).select(SUB, *carry)
    started = (F.col("term_number") == 1) & (F.col("term_started_at") < day(cal.start_cutoff))
    return join_split(terms.filter(started), eligible, SUB, "inner" if carry else "left_semi")


def qualified_terms(terms: DataFrame, subscriptions: DataFrame, cal: Calendar) -> DataFrame:
    """First terms of paid, activated subscriptions that started early enough; ids only."""
    return cohort_terms(terms, subscriptions, cal).select(SUB, TERM).distinct()


def only_first_terms(terms: DataFrame) -> DataFrame:
    """The first term of every subscription that has exactly one.

    "Exactly one distinct id" is "smallest equals largest", which combines map-side.
    """
    return (
        terms.filter(F.col("term_number") == 1)
        .groupBy(SUB)
        .agg(F.min(TERM).alias(TERM), F.max(TERM).alias("hi"))
        .filter(F.col(TERM) == F.col("hi"))
        .select(TERM)
    )


def refine(cohort: DataFrame, terms: DataFrame) -> DataFrame:
    """Drop subscriptions with several first terms.

    Said from the other side, as a semi-join on the term: a subscription with very many first terms
    is never one task, and the result is laid out by term for the joins that follow.
    """
    return cohort.join(only_first_terms(terms), TERM, "left_semi")


def restrict_to(rows: DataFrame, cohort: DataFrame, key: str = SUB, hashed: bool = False) -> DataFrame:
    """Rows whose key is in the cohort, each once; a hot key is split.

    ``hashed`` is for many or wide rows: they are exchanged only where they do not lie by the key already (AQE adds that
    exchange where it splits a hot key further down), and instead of being sorted they pass a hash table of their
    partition's keys. The keys are laid apart first, so that they are exchanged right below the join, as splitting asks.
    """
    keys = cohort.select(key).distinct()
    if hashed:
        return rows.join(keys.repartition(F.xxhash64(key)).hint("shuffle_hash"), key, "left_semi")
    return join_split(rows, keys, key, "left_semi")


def with_cancellation_type(terms: DataFrame, cal: Calendar) -> DataFrame:
    """Term rows with voluntary / involuntary / not_cancelled / null."""
    kind = cancellation_type("cancel_requested_at", "term_ended_at", cal.label_cutoff)
    return terms.withColumn("cancellation_type", kind)


def valid_cohort(typed: DataFrame, terms: DataFrame, on_term: bool = False) -> DataFrame:
    """Typed cohort rows that have a term which is not an unexplained end.

    A term that ended without a request although its payment-failure flag is explicitly false is
    ambiguous. Matching on the subscription lets any other term of it bring the row back, once per
    such term: that multiplicity is ``n_rows``, so one hot subscription stays one row.
    ``on_term=True`` judges each row by its own term.
    """
    key = TERM if on_term else SUB
    ambiguous = (
        F.col("cancel_requested_at").isNull()
        & F.col("term_ended_at").isNotNull()
        & is_false("is_failed_payment_canceled")
    )
    kept = terms.filter(~ambiguous).groupBy(key).agg(F.count("*").alias("n_rows"))
    return typed.join(kept, key)


def repeat_rows(df: DataFrame, times: str = "n_rows") -> DataFrame:
    """Literal rows of a frame that carries multiplicities.

    Small multiplicities fan out where the row lies. Larger ones are cut into chunks of 65,536 copies, and the chunks are
    exchanged before they fan out, so that the copies of one row come from all tasks.
    """
    most = 1 << 16
    here = df.where(F.col(times).between(1, most)).withColumn("_copies", F.col(times))
    chunks = F.explode(F.sequence(F.lit(1).cast("bigint"), F.ceil(F.col(times) / most)))
    in_chunk = F.least(F.lit(most), F.col(times) - (F.col("_chunk") - 1) * most)
    cut = df.where(F.col(times) > most).withColumn("_chunk", chunks).withColumn("_copies", in_chunk)
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut.repartition(partitions, "_chunk", *df.columns).drop("_chunk")
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies").cast("bigint")))
    return here.unionByName(dealt).withColumn("_copy", copies).drop(times, "_copies", "_copy")


def single_plan_subscriptions(plan_terms: DataFrame) -> DataFrame:
    """Subscriptions that never changed plan, with the plan's cadence."""
    plan = "subscription_plan_term_id"
    return (
        plan_terms.groupBy(SUB)
        .agg(F.min(plan).alias("lo"), F.max(plan).alias("hi"), F.min("term_months").alias("term_months"))
        .filter(F.col("lo") == F.col("hi"))
        .select(SUB, "term_months")
    )


def first_plan_of_activated(subscriptions: DataFrame, plan_terms: DataFrame) -> DataFrame:
    activated = subscriptions.filter(F.col("is_activated")).select(SUB, "is_activated")
    first = plan_terms.filter((F.col("term_number") == 1) & (F.col("plan_term_number") == 1))
    return activated.join(
        first.select(SUB, "drug_name", "regimen", "term_months", F.col("monthly_dose").cast("double").alias("monthly_dose")),
        SUB,
    )


def wanted_plan_of_fell_out(subscriptions: DataFrame, plan_types: DataFrame) -> DataFrame:
    """What never-activated subscribers asked for.

    The drug's name is the only thing taken from the catalogue, so its plans are first folded into
    one row per (drug, name); ``n_plans`` is how many catalogue plans stand behind it.
    """
    drugs = plan_types.groupBy("drug_id", "drug_name").agg(F.count("*").alias("n_plans"))
    wanted = subscriptions.filter(~F.col("is_activated")).select(
        SUB,
        "is_activated",
        F.col("current_regimen").alias("regimen"),
        cadence_months("current_days_supply").alias("term_months"),
        F.col("current_quantity").alias("quantity"),
        F.col("current_drug_id").alias("drug_id"),
    )
    return wanted.join(drugs, "drug_id").select(
        SUB,
        "is_activated",
        "drug_name",
        "regimen",
        "term_months",
        (F.col("quantity") / F.col("term_months")).alias("monthly_dose"),
        "n_plans",
    )


def wanted_plan_rows(subscriptions: DataFrame, plan_types: DataFrame) -> DataFrame:
    """:func:`wanted_plan_of_fell_out` as literal rows: one for each catalogue plan of the drug."""
    return repeat_rows(wanted_plan_of_fell_out(subscriptions, plan_types), "n_plans")


def latest_plan(plan_terms: DataFrame, *columns: str) -> DataFrame:
    """One row per term: its current plan, filtered before any join."""
    return plan_terms.filter(F.col("is_latest_plan_term")).select(TERM, *columns)
