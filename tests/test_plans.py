"""Plan shape: what must hold at any size, read from the plans Spark prints."""

import math
import re

import pytest
from conftest import DATA

import __spark_entry__ as entry
from tenurekit.config import TableNames
from tenurekit.plans import lake as lake_module
from tenurekit.plans.lake import SILVER_TABLES, Lake
from tenurekit.plans.pipeline import build_silver
from tenurekit.sources import standin
from tenurekit.sources.casts import SOURCE_TABLES
from tenurekit.sources.standin import CALENDAR, CONDITION
from tenurekit.sources.tables import write_table

QUERIES = entry.queries()
WRITES = {name for name in QUERIES if name.startswith("io")}


def plan_of(df, capsys):
    df.explain("simple")
    return capsys.readouterr().out


@pytest.fixture()
def no_broadcast(spark):
    """Plans as for inputs too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITES))
def test_no_cross_join_and_no_python_on_rows(no_broadcast, capsys, name):
    plan = plan_of(QUERIES[name](no_broadcast, DATA), capsys)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    python = re.findall(r"(\w*EvalPython|\w+InPandas|BatchEvalPython)", plan)
    allowed = 1 if name.endswith("_chi2") or name.startswith(("st2_", "st3_", "st5_")) else 0
    assert len(python) <= allowed


def test_filters_and_columns_reach_the_scan(spark, capsys, tmp_path):
    path = str(tmp_path / "terms")
    Lake.from_standin(spark, DATA).terms.write.parquet(path)
    lake = Lake.from_standin(spark, DATA)
    terms = spark.read.parquet(path)
    stored = Lake({**{t: lake.source[t] for t in ("subscriptions_core",)}, "subscription_terms": terms}, CALENDAR, CONDITION)
    stored.qualified.explain("formatted")
    plan = capsys.readouterr().out
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line and "term_number" in line)
    assert "EqualTo(term_number,1)" in pushed and "LessThan(term_started_at" in pushed
    schema = next(line for line in plan.splitlines() if "ReadSchema" in line and "term_number" in line)
    assert set(re.findall(r"(\w+):", schema.split("struct")[1])) == {
        "subscription_id", "subscription_term_id", "term_number", "term_started_at"}


def test_hot_groups_are_combined_before_the_shuffle(no_broadcast, capsys):
    """Invoices meet the snapshots as one row per (term, day), counted map-side first."""
    plan = plan_of(QUERIES["ft1_invoice_failure_by_week"](no_broadcast, DATA), capsys)
    assert "partial_count" in plan
    assert len(re.findall("SortMergeJoin|ShuffledHashJoin", plan)) >= 1


def test_features_read_stored_activity_without_an_exchange(no_broadcast, capsys):
    """Bounds and daily counts are stored by term: the feature table is two scans and one join."""
    for name in ("g1_snapshot_features", "g1_snapshot_features_strict"):
        plan = plan_of(QUERIES[name](no_broadcast, DATA), capsys)
        assert len(re.findall("FileScan", plan)) == 2 and "Exchange" not in plan
        assert plan.count("Bucketed: true") == 2
    plan = plan_of(QUERIES["st2_candidate_tests"](no_broadcast, DATA), capsys)
    assert len(re.findall("FileScan", plan)) == 2 and len(re.findall("Exchange", plan)) <= 5


def test_line_items_are_exchanged_once_for_plan_terms(no_broadcast, capsys):
    """Both inner queries of the numbering are one exchange; adaptive plans show that once they have run."""
    lines = Lake.from_standin(no_broadcast, DATA).source["numbered_lines"]
    assert lines.count() == lines.select("l_orderkey", "n").distinct().count() > 0
    lines.collect()
    assert "ReusedExchange" in plan_of(lines, capsys)


COMPARED = [
    "q00_8_cancel_status_share", "q00_36_subscriber_types", "q01_7_share_by_drug", "q01_11_share_by_state",
    "q02_3_days_signup_to_rx", "q02_5_survival_by_cadence", "q03_8_all_attempts_failed", "q03_18_payment_behaviour",
    "q04_5_rate_by_cadence", "q04_14_rate_by_failed_invoices", "q04_17_rate_by_platform", "ft7_deferrals_by_week",
    "ft10_plan_changes_by_week", "st2_candidate_tests", "qd_6_renewed_after_deferral", "qr_10_rate_by_visits",
    "g1_snapshot_features",
]


def test_stored_tables_answer_like_derived_ones(spark):
    derived = Lake.from_standin(spark, DATA)
    names = TableNames(prefixes={"bronze": "pb_", "silver": "ps_", "gold": "pg_"})
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    for table in SOURCE_TABLES:
        write_table(derived.source[table], names.table("bronze", table), storage_path=f"{shared}/plans/bronze/{table}")
    bronze = Lake.from_tables(spark, names, CALENDAR, CONDITION)
    report = build_silver(spark, bronze, names, storage_root=f"{shared}/plans/silver").collect()
    assert len(report) == len(SILVER_TABLES) and all(r.error is None and r.n_rows > 0 for r in report)
    stored = Lake.from_tables(spark, names, CALENDAR, CONDITION, silver=tuple(SILVER_TABLES))
    from tenurekit.plans import analyses

    for name in COMPARED:
        one, other = (sorted(map(str, analyses()[name](lake).collect())) for lake in (derived, stored))
        assert one == other, name


def test_listed_snapshots_are_never_broadcast(spark, capsys):
    """Their estimated size is that of their terms."""
    plan = plan_of(QUERIES["q00_35_involuntary_stop_rule"](spark, DATA), capsys)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan.split("SortMergeJoin")[0]


def _lines(spark, rows, tmp_path):
    schema = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("hot", [0, 4, 1 << 16])
def test_line_items_are_numbered_alike_on_both_paths(spark, monkeypatch, tmp_path, hot):
    monkeypatch.setattr(standin, "HOT_ORDER", hot)
    rows = [(o, n % 3, p, s) for o in (1, 2, 3, None) for n in range(2 * (o or 1)) for p, s in ((n, n), (n - 70, None), (n + 64, 1))]
    rows += rows[::2] + [(5, None, 1, 1), (5, 1, None, 1)]
    found = standin.StandIn(spark, _lines(spark, rows, tmp_path))["numbered_lines"]
    key = lambda r: (r[1], math.fmod(r[2], 64), r[2], -1 if r[3] is None else r[3])
    want = set()
    for o in (1, 2, 3):
        own = sorted({r for r in rows if r[0] == o}, key=key)
        want |= {(o, r[2], r[3], i + 1, len(own)) for i, r in enumerate(own)}
    got = [tuple(r) for r in found.select("l_orderkey", "p", "s", "n", "n_plans").collect()]
    assert len(got) == len(want) and set(got) == want


def test_plan_terms_exchange_the_lines_of_ordinary_orders_once(no_broadcast, capsys):
    """One exchange of lines serves numbers, counts and the join to orders; the counted orders need their own."""
    lines = Lake.from_standin(no_broadcast, DATA).source
    ordinary = plan_of(lines._sql("subscription_plan_terms", {"numbered_lines": lines._cold_lines}), capsys)
    by_line = [line for line in ordinary.splitlines() if "REPARTITION_BY_NUM" in line]
    others = [line for line in ordinary.splitlines() if "Exchange hashpartitioning" in line and "REPARTITION_BY_NUM" not in line]
    assert len(set(re.sub(r".*Exchange|#\d+|plan_id=\d+", "", line) for line in by_line)) == 1 and len(others) <= 3


def test_buckets_follow_the_number_of_terms(no_broadcast, monkeypatch):
    """A bucket's snapshots must fit a task, however many terms there are."""
    monkeypatch.setattr(lake_module, "BUCKET_TERMS", 50)
    lake = Lake.from_standin(no_broadcast, DATA)
    terms = lake.profile.count()
    assert terms > 50 * int(no_broadcast.conf.get("spark.sql.shuffle.partitions"))
    joined = lake.days.join(lake.profile, "subscription_term_id")
    assert joined.hint("merge").rdd.getNumPartitions() == -(-terms // 50)


def test_best_windows_take_the_tests_once(no_broadcast, capsys):
    plan = plan_of(QUERIES["st3_best_windows"](no_broadcast, DATA), capsys)
    assert len(re.findall("FileScan", plan)) == 2


def test_deferred_days_are_not_exchanged_once_listed(no_broadcast, capsys):
    """Rows meet by subscription before they are spread over snapshots."""
    plan = plan_of(QUERIES["ft8_days_deferred_per_snapshot"](no_broadcast, DATA), capsys)
    assert "Exchange" not in plan.split("Generate")[0]


def test_attempts_fold_in_small_pieces(no_broadcast, capsys):
    """Charges meet the cohort without a sort of listed attempts, and no task folds more than one of the pieces."""
    plan = plan_of(QUERIES["q03_7_failed_charges_by_attempt"](no_broadcast, DATA), capsys)
    listed = plan[: plan.index("explode(sequence(1, num_charges")].splitlines()
    assert sum("REPARTITION_BY_NUM" in line for line in listed) == 1 and sum("HashAggregate" in line for line in listed) == 4
    assert sum("Sort " in line for line in listed) == 1


def test_listed_charges_are_not_exchanged(no_broadcast, capsys):
    plan = plan_of(QUERIES["sv6_charges"](no_broadcast, DATA), capsys)
    listed = plan[: plan.index("explode(sequence(1, num_charges")]
    assert "Exchange" not in listed and "Sort" not in listed and "ShuffledHashJoin" in listed


def test_wide_invoices_are_not_sorted_for_the_cohort(no_broadcast, capsys):
    plan = plan_of(QUERIES["sv7_invoices"](no_broadcast, DATA), capsys)
    by_term = next(line for line in plan.splitlines() if "Join [subscription_term_id" in line)
    assert "ShuffledHashJoin" in by_term and "LeftSemi" in by_term
