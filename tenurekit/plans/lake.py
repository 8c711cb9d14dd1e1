"""One study's tables: landed sources, and the conformed tables derived from them on demand."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tenurekit.config import Calendar, TableNames, apply_runtime_defaults
from tenurekit.operators import cohort as co
from tenurekit.operators import conform as cf
from tenurekit.operators import features as ft
from tenurekit.operators import labels as lb
from tenurekit.sources import standin
from tenurekit.sources.casts import SOURCE_TABLES
from tenurekit.sources.scratch import fresh_folder
from tenurekit.sources.tables import read_table, write_bucketed


#: Terms of one bucket: their snapshots, at most 53 each with all features, fit the memory of a task that sums them.
BUCKET_TERMS = 1 << 14
#: Spark's own bound of buckets.
MOST_BUCKETS = 100_000


class Lake:
    """Lazy frames: building a lake runs nothing, and reading an attribute nothing but writing those three tables.

    ``silver`` holds conformed tables that are already stored. What is not stored is planned from the
    sources, so the same analyses run before and after :func:`~tenurekit.plans.pipeline.build_silver`.
    ``profile`` (bounds of terms), ``days`` (their daily counts) and ``plan_steps`` feed the reports. They are written once, on
    first use, to the shared folder; the first two are bucketed by term and read without planning the cohort again or
    exchanging it.
    """

    def __init__(
        self,
        source: Mapping[str, DataFrame],
        calendar: Calendar,
        condition: str,
        silver: Mapping[str, DataFrame] | None = None,
    ) -> None:
        self.source, self.calendar, self.condition = source, calendar, condition
        self._silver = dict(silver or {})
        self._buckets: int | None = None

    @classmethod
    def from_standin(cls, spark: SparkSession, folder: str) -> Lake:
        apply_runtime_defaults(spark)
        return cls(standin.StandIn(spark, folder), standin.CALENDAR, standin.CONDITION)

    @classmethod
    def from_tables(
        cls,
        spark: SparkSession,
        names: TableNames,
        calendar: Calendar,
        condition: str,
        silver: tuple[str, ...] = (),
    ) -> Lake:
        """Landed tables by name, and those conformed tables that ``silver`` lists as stored."""
        apply_runtime_defaults(spark)
        source = {t: read_table(spark, names.table("bronze", t)) for t in SOURCE_TABLES}
        source["subscriptions_core"] = source["subscriptions"]
        stored = {t: read_table(spark, names.table("silver", t)) for t in silver}
        return cls(source, calendar, condition, stored)

    def cohort_rows(self, name: str) -> DataFrame:
        """Rows for a caller that joins the cohort itself: the stored conformed table when there is
        one, else the source table, which saves a semi-join that the caller's join repeats."""
        return self._silver[name] if name in self._silver else self.source[name]

    @property
    def cohort_events(self) -> DataFrame:
        """Events for a caller that joins the cohort itself."""
        return self._silver["subs_kafka__events"] if "subs_kafka__events" in self._silver else self.raw_events

    @property
    def terms(self) -> DataFrame:
        return self.source["subscription_terms"]

    @property
    def people(self) -> DataFrame:
        """Subscriptions without the home state, which costs a join in the derived inputs."""
        return self.source["subscriptions_core"]

    @property
    def subscriptions(self) -> DataFrame:
        return self.source["subscriptions"]

    @property
    def raw_events(self) -> DataFrame:
        return self.source["int_subs_kafka__events"]

    # ------------------------------------------------------------ cohort and conformed tables

    @cached_property
    def cohort_terms(self) -> DataFrame:
        """Qualified terms with all term columns."""
        if "subscription_terms_qualified" in self._silver:
            return co.restrict_to(self.terms, self.qualified, co.TERM)
        return co.cohort_terms(self.terms, self.people, self.calendar)

    @cached_property
    def qualified(self) -> DataFrame:
        return self._stored("subscription_terms_qualified", lambda: co.qualified_terms(self.terms, self.people, self.calendar))

    @cached_property
    def refined_terms(self) -> DataFrame:
        return co.refine(self.cohort_terms, self.terms)

    @cached_property
    def refined(self) -> DataFrame:
        return co.refine(self.qualified, self.terms)

    @cached_property
    def plan_types(self) -> DataFrame:
        return self._stored(
            "subscription_plan_types",
            lambda: cf.conform_plan_types(self.source["subscription_plan_types"], self.condition),
        )

    @cached_property
    def silver_subscriptions(self) -> DataFrame:
        return self._stored("subscriptions", lambda: cf.conform_subscriptions(self.subscriptions, self.qualified))

    @cached_property
    def all_terms(self) -> DataFrame:
        return self._stored("subscription_all_terms", lambda: cf.conform_terms(self.terms, self.qualified, self.calendar))

    @cached_property
    def plan_terms(self) -> DataFrame:
        return self._stored(
            "subscription_plan_terms",
            lambda: cf.conform_plan_terms(self.source["subscription_plan_terms"], self.qualified),
        )

    @cached_property
    def charges(self) -> DataFrame:
        return self._stored(
            "subscription_charges", lambda: cf.conform_charges(self.source["subscription_charges"], self.qualified)
        )

    @cached_property
    def invoices(self) -> DataFrame:
        return self._stored(
            "subscription_invoices",
            lambda: cf.conform_invoices(
                self.source["subscription_invoices"], self.source["subscription_plan_types"], self.qualified
            ),
        )

    @cached_property
    def events(self) -> DataFrame:
        return self._stored("subs_kafka__events", lambda: cf.conform_events(self.raw_events, self.qualified))

    @cached_property
    def labels(self) -> DataFrame:
        return self._stored("subscription_30d_cancel_label", lambda: lb.start_label(self.cohort_terms, self.calendar))

    @cached_property
    def profile(self) -> DataFrame:
        """Bounds with their subscription's platform and channel; stored by term."""
        if "subscription_terms_qualified" in self._silver:
            rows = ft.term_profile(lb.snapshot_bounds(self.cohort_terms, self.calendar), self.people)
        else:  # the join that restricts terms to the cohort brings the columns along
            carried = ft.profile_columns(self.people).select(co.SUB, "is_paid", "is_activated", *ft.PROFILE)
            terms = co.cohort_terms(self.terms, carried, self.calendar, carry=ft.PROFILE)
            rows = lb.snapshot_bounds(terms, self.calendar, carry=ft.PROFILE)
        return self._by_term(self._kept(rows, "profile_rows"), "profile")

    @cached_property
    def bounds(self) -> DataFrame:
        return self.profile.drop(*ft.PROFILE)

    @cached_property
    def days(self) -> DataFrame:
        """Daily counts of all sources; stored by term."""
        invoices = self.cohort_rows("subscription_invoices")
        return self._by_term(ft.activity_days(self.bounds, invoices, self.cohort_events, self.plan_steps, self.calendar), "days")

    @cached_property
    def plan_steps(self) -> DataFrame:
        """Plan terms with the columns that reports read. Written once as they come, without an exchange: a term may own any
        share of them."""
        if "subscription_plan_terms" in self._silver:
            return ft.plan_steps(self._silver["subscription_plan_terms"])
        return self._kept(ft.plan_steps(self.source["subscription_plan_terms"]), "plan_steps")

    @staticmethod
    def _kept(rows: DataFrame, name: str) -> DataFrame:
        path = fresh_folder(rows.sparkSession, f"features/{name}")
        rows.write.parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def _by_term(self, rows: DataFrame, name: str) -> DataFrame:
        spark = rows.sparkSession
        target, path = f"tenure_{name}_{uuid.uuid4().hex}", fresh_folder(spark, f"features/{name}")
        if self._buckets is None:  # of the first table, the profile: one row a term
            least = int(spark.conf.get("spark.sql.shuffle.partitions"))
            self._buckets = min(MOST_BUCKETS, max(least, -(-rows.count() // BUCKET_TERMS)))
        return write_bucketed(rows, target, co.TERM, buckets=self._buckets, storage_path=path)

    @cached_property
    def snapshots(self) -> DataFrame:
        return self._stored("subscription_weekly_snapshots", lambda: lb.weekly_snapshots(self.bounds, self.calendar))

    # ------------------------------------------------------------ analysis cohorts

    @cached_property
    def labels_refined(self) -> DataFrame:
        return lb.start_label(self.refined_terms, self.calendar)

    @cached_property
    def typed(self) -> DataFrame:
        """Refined cohort with its cancellation type and the term columns reports group by."""
        return co.with_cancellation_type(self.refined_terms, self.calendar)

    @cached_property
    def valid(self) -> DataFrame:
        return co.valid_cohort(self.typed, self.terms)

    def latest_plan(self, *columns) -> DataFrame:
        return co.latest_plan(self.plan_steps, *columns)

    def _stored(self, name: str, derive) -> DataFrame:
        return self._silver[name] if name in self._silver else derive()


SILVER_TABLES = {
    "subscription_terms_qualified": ("qualified", ()),
    "subscription_plan_types": ("plan_types", ()),
    "subscriptions": ("silver_subscriptions", ("subs_activated_at", co.SUB)),
    "subscription_all_terms": ("all_terms", (co.SUB, "term_started_at")),
    "subscription_plan_terms": ("plan_terms", (co.SUB, "plan_term_started_at")),
    "subscription_charges": ("charges", (co.SUB, "occurred_at")),
    "subscription_invoices": ("invoices", (co.SUB, "created_at")),
    "subs_kafka__events": ("events", (co.SUB, "raw_occurred_at")),
    "subscription_30d_cancel_label": ("labels", ()),
    "subscription_weekly_snapshots": ("snapshots", ()),
}
