"""Concurrent builds, writes that replace whole tables, counts taken by the write, and split CSV files."""

import random
import threading
import time
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tenurekit.config import TableNames
from tenurekit.plans import analyses, ingest
from tenurekit.plans.lake import Lake
from tenurekit.sources import files, tables
from tenurekit.sources.builds import Build, build_all
from tenurekit.sources.split_csv import read_split_csv, records
from tenurekit.sources.tables import order_report, write_counted


def test_independent_builds_overlap_and_needs_come_first(spark):
    both = threading.Barrier(2, timeout=30)
    ended = []

    def waiting(name):
        def run():
            both.wait()
            ended.append(name)
            return spark.range(5).count()

        return run

    builds = {
        "last": Build(lambda: ended.append("last"), ("a", "b")), "a": Build(waiting("a"), ("first",)), "b": Build(waiting("b"), ("first",)),
        "first": Build(lambda: ended.append("first")),
    }
    outcomes = build_all(spark, builds)
    assert list(outcomes) == list(builds) and outcomes["a"].result == 5
    assert ended[0] == "first" and ended[-1] == "last" and set(ended[1:3]) == {"a", "b"}


def test_a_failing_build_leaves_the_others(spark):
    outcomes = build_all(spark, {
        "bad": Build(lambda: spark.table("no_such_table").count()), "needs_bad": Build(lambda: 1, ("bad",)), "good": Build(lambda: spark.range(3).count()),
        "task": Build(lambda: spark.range(3).select(F.raise_error(F.lit("no"))).collect()),
    })
    assert outcomes["bad"].error == "TABLE_OR_VIEW_NOT_FOUND" and outcomes["needs_bad"].error == "NEEDS_BAD"
    assert outcomes["good"].result == 3 and outcomes["task"].error


def test_needs_must_be_known_and_free_of_circles(spark):
    with pytest.raises(ValueError, match="no build named"):
        build_all(spark, {"a": Build(lambda: 1, ("z",))})
    with pytest.raises(ValueError, match="need one another"):
        build_all(spark, {"a": Build(lambda: 1, ("b",)), "b": Build(lambda: 1, ("a",))})


@pytest.mark.parametrize("change", ["same", "other"])
def test_a_failed_write_leaves_the_old_rows(spark, tmp_path, change):
    name, place = f"kept_{change}", str(tmp_path / "kept")
    tables.write_table(spark.range(10), name, storage_path=place)
    bad = spark.range(100).withColumn("id", F.when(F.col("id") == 99, F.raise_error(F.lit("late"))).otherwise(F.col("id")).cast("bigint"))
    bad = bad if change == "same" else bad.withColumn("x", F.lit(1))
    with pytest.raises(Exception, match="late"):
        tables.write_table(bad, name, storage_path=place)
    assert [r.id for r in tables.read_table(spark, name).orderBy("id").collect()] == list(range(10))
    tables.write_table(spark.range(3), name, storage_path=place)
    assert tables.read_table(spark, name).count() == 3


def test_a_table_may_be_rewritten_from_itself(spark, tmp_path):
    tables.write_table(spark.range(10), "grows", storage_path=str(tmp_path / "g"))
    tables.write_table(tables.read_table(spark, "grows").selectExpr("id * 2 AS id"), "grows", storage_path=str(tmp_path / "g"), sort_by=["id"])
    assert [r.id for r in tables.read_table(spark, "grows").orderBy("id").collect()] == list(range(0, 20, 2))


def test_counts_are_those_of_the_write(spark, tmp_path):
    rows = spark.range(1000).withColumn("x", F.when(F.col("id") % 4 > 0, F.col("id")))
    counts = {"n_rows": F.count("*"), "x": F.count_if(F.col("x").isNull())}
    assert tables.write_counted(rows, "counted", counts, storage_path=str(tmp_path / "c"), sort_by=["x"]) == {"n_rows": 1000, "x": 250}
    assert tables.write_counted(rows.limit(0), "counted", counts, storage_path=str(tmp_path / "c")) == {"n_rows": 0, "x": 0}


def test_clustered_files_are_in_order(spark, tmp_path):
    rows = spark.range(20_000, numPartitions=7).select((F.col("id") * 7919 % 20_000).alias("k"), F.lit("x").alias("v"))
    tables.write_table(rows, "clustered", storage_path=str(tmp_path / "s"), sort_by=["k"])
    assert tuple(tables.order_report(tables.read_table(spark, "clustered"), ["k"]).first()) == (20_000, 0, 0)
    tables.write_table(rows, "unclustered", storage_path=str(tmp_path / "u"))
    found = tables.order_report(tables.read_table(spark, "unclustered"), ["k"]).first()
    assert found.n_rows == 20_000 and found.n_unsorted > 0 and found.n_overlapping == 6


def test_one_failing_export_is_a_row_of_the_report(spark, tmp_path):
    good = tmp_path / "orders.csv"
    good.write_text("order_id,status,created_at,completed_at,confirmed_at\n1,x,2026-01-01,,\n")
    names = TableNames(prefixes={"bronze": "fx_", "silver": "fy_", "gold": "fz_"})
    paths = {"subscription_orders": str(good), "subscription_plan_types": str(tmp_path / "absent.csv")}
    report = files.ingest_exports(spark, names, list(paths), files=paths, storage_root=str(tmp_path / "out")).collect()
    assert {(r.column_name, r.n_rows, r.n_null) for r in report if r.table_name == "subscription_orders"} == {
        ("created_at", 1, 0), ("completed_at", 1, 1), ("confirmed_at", 1, 1)}
    assert [r.error for r in report if r.table_name == "subscription_plan_types"] == ["PATH_NOT_FOUND"]


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def _field(r):
    plain = r.choice(["a", "", "12.5", "b c", "é漢", "x;y"])
    inner = "".join(r.choice(["l", "\n", '""', ",", " ", "\n\n", "line of text "]) for _ in range(r.randrange(30)))
    return plain if r.random() < 0.7 else f'"{inner}"'


@pytest.mark.parametrize("seed", range(3))
def test_split_files_equal_the_multi_line_reader(spark, small_splits, tmp_path, seed):
    """Quoted line feeds, doubled quotes and commas; records run over several splits."""
    r = random.Random(seed)
    for part in range(2):
        body = ["i,a,b,c"]
        for i in range(600):
            huge = '"' + "over\nmany splits, " * 1500 + '"' if i == 77 else _field(r)
            body.append(f"{part}-{i},{_field(r)},{huge},{_field(r)}")
            if r.random() < 0.05:
                body.append("")
        (tmp_path / f"p{part}.csv").write_text("\n".join(body) + ("\n" if part else ""))
    split, whole = (files.read_csv_strings(spark, str(tmp_path), split=s) for s in (True, False))
    assert split.columns == whole.columns
    assert read_split_csv(spark, str(tmp_path)).rdd.getNumPartitions() > 1
    assert sorted(map(str, split.collect())) == sorted(map(str, whole.collect()))


def test_files_with_carriage_returns_and_without_rows(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes(b'a,b\r\n1,"x\r\ny"\r\n2,z\r\n')
    split, whole = (sorted(map(str, files.read_csv_strings(spark, str(tmp_path / "r.csv"), split=s).collect())) for s in (True, False))
    assert [s.replace("\\r", "") for s in split] == [w.replace("\\r", "") for w in whole] and len(split) == 2
    (tmp_path / "e.csv").write_text("a,b\n")
    assert files.read_csv_strings(spark, str(tmp_path / "e.csv"), split=True).collect() == []


def test_whole_lines_of_a_split_file_are_not_exchanged(spark, small_splits, tmp_path, capsys):
    """Only pieces of records with line feeds are; whole lines are parsed where they are read."""
    (tmp_path / "w.csv").write_text("a,b\n" + "".join(f'{i},"x ""{i}"""\n' for i in range(5000)))
    assert read_split_csv(spark, str(tmp_path / "w.csv")).count() == 5000
    records(spark, str(tmp_path / "w.csv")).where("text <> ''").explain("simple")
    whole = capsys.readouterr().out.split("Union")[1].split("\n   +- ")[0]  # the first branch, above its join
    assert "MapInArrow" in whole and "Window" not in whole.split("BroadcastExchange")[0]


def test_sorted_writes_keep_no_second_copy(spark, tmp_path):
    """Each row is written once and counted once, and the ranges are cut without a stored copy."""
    from tenurekit.sources.scratch import shared_folder

    def files_of(folder):
        return {str(f) for f in Path(folder).rglob("*.parquet")}

    before = files_of(shared_folder(spark))
    rows = spark.range(0, 20_000, 1, 7).selectExpr("id % 11 AS k", "id AS v")
    counts = write_counted(rows, "sorted_once", {"n": F.count("*"), "v": F.sum("v")}, storage_path=str(tmp_path / "s"), sort_by=["k", "v"])
    assert counts == {"n": 20_000, "v": sum(range(20_000))}
    assert files_of(shared_folder(spark)) == before
    assert order_report(spark.table("sorted_once"), ["k", "v"]).first().asDict() == {"n_rows": 20_000, "n_unsorted": 0, "n_overlapping": 0}


def test_compressed_exports_are_cut_and_read_as_plain_ones(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "PART_ROWS", 100)
    body = spark.range(0, 1_000, 1, 2).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit('a "b", c\n'), F.col("id").cast("string"))).alias("text"))
    lake = SimpleNamespace(source={"t": body})
    read = {}
    for codec in (None, "gzip"):
        path = ingest._export(lake, str(tmp_path / str(codec)), "t", codec)
        read[codec] = sorted(map(str, read_split_csv(spark, path).collect()))
        parts = [p for p in Path(path).iterdir() if p.name.startswith("part-")]
        assert all(p.name.endswith(".gz") for p in parts) == bool(codec) and (len(parts) == 10 or not codec)
    assert read["gzip"] == read[None] and len(read[None]) == 1_000


def test_the_ingest_report_exports_compressed_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "fresh_folder", lambda *_: str(tmp_path / "ingest"))
    report = analyses()["io7_io8_ingest_report"](Lake.from_standin(spark, "/root/testdata/sf0.001"))
    parts = [p for p in tmp_path.rglob("part-*") if ".csv/" in str(p)]
    assert parts and all(p.name.endswith(".csv.gz") for p in parts)
    assert report.count() == 94
    bronze = [p for p in (tmp_path / "ingest/bronze").rglob("part-*")]
    assert bronze and all(".zstd." in p.name for p in bronze)


def test_builds_leave_no_shuffle_files(spark, tmp_path):
    def found():
        files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in files.split("\n") if "shuffle_" in f}

    before, setting = found(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    rows = spark.range(20_000).select(F.hash("id").alias("k"))
    run = {n: Build(lambda n=n: write_counted(rows, f"left_{n}", {"n": F.count("*")}, storage_path=str(tmp_path / n), sort_by=("k",))["n"]) for n in "ab"}
    assert [o.result for o in build_all(spark, run).values()] == [20_000, 20_000]
    for _ in range(50):
        if not (left := found() - before):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting
