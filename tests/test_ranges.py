"""Ranges cut at the data's own quantiles: even whatever the values, and exact totals and carries across them."""

import random

import pytest
from pyspark.sql import functions as F

from tenurekit.operators.ordered import running_totals, with_previous_known
from tenurekit.operators.ranges import cut_points, n_ranges, with_range


def largest_share(ranged):
    counts = [r["count"] for r in ranged.groupBy("_range").count().collect()]
    return max(counts) / sum(counts)


@pytest.fixture(scope="module")
def prices(spark):
    """200,000 distinct values within 1 % of each other."""
    return spark.range(200_000).select((1000 + F.col("id") / 20_000).alias("v"), (F.col("id") % 7).alias("n")).repartition(8)


def test_close_values_fill_all_ranges(prices):
    ranged = with_range(prices, ["v"])
    assert ranged.select("_range").distinct().count() >= 64 and largest_share(ranged) < 0.05


def test_cut_points_are_the_same_in_every_evaluation(prices):
    cuts = [cut_points(df, ["v"], 64).first().cuts for df in (prices, prices.repartition(3), prices.coalesce(1))]
    assert cuts[0] == cuts[1] == cuts[2] and cuts[0] == sorted(cuts[0])


def test_running_totals_over_close_values(prices):
    totals = running_totals(prices, "v", ["n"])
    rows = totals.select(F.round((F.col("v") - 1000) * 20_000).cast("int").alias("i"), "n_before", "n_total").orderBy("i").collect()
    before = 0
    for i, r in enumerate(rows):
        assert (r.i, r.n_before) == (i, before)
        before += i % 7
    assert len(rows) == 200_000 and all(r.n_total == before for r in rows)


def test_running_totals_of_a_hot_group_and_odd_values(spark):
    rng = random.Random(4)
    values = [None, float("-inf"), float("nan"), float("inf"), -0.5, 0.0, *(rng.uniform(-1e-9, 1e12) for _ in range(3000))]
    rows = [("hot", v, rng.randrange(9)) for v in values] + [(f"g{i}", v, 1) for i in range(300) for v in (1.0, 2.0)]
    got = running_totals(spark.createDataFrame(rows, "g string, v double, n bigint"), "v", ["n"], ["g"]).collect()
    assert len(got) == len(rows)

    def place(v):
        return (0, 0) if v is None else (2, 0) if v != v else (1, v)

    want, total = {}, 0
    for _, v, n in sorted((r for r in rows if r[0] == "hot"), key=lambda r: place(r[1])):
        want[place(v)] = total
        total += n
    for r in got:
        assert r.n_before == (want[place(r.v)] if r.g == "hot" else int(r.v) - 1)
        assert r.n_total == (total if r.g == "hot" else 2)


def test_few_rows_and_none(spark):
    one = spark.createDataFrame([(1.0, 5)], "v double, n bigint")
    assert [(r.n_before, r.n_total) for r in running_totals(one, "v", ["n"]).collect()] == [(0, 5)]
    assert running_totals(one.limit(0), "v", ["n"]).count() == 0
    known = spark.createDataFrame([("k", 1, 1, "x")], "k string, m int, i int, v string")
    assert [r.previous_v for r in with_previous_known(known, "k", "m", "i", ["v"]).collect()] == [None]
    assert with_previous_known(known.limit(0), "k", "m", "i", ["v"]).count() == 0


@pytest.fixture(scope="module")
def hot_moment():
    """A third of all rows on one (key, moment), a third without a moment, the others anywhere."""
    rng = random.Random(12)
    rows = []
    for i in range(30_000):
        value = [rng.choice([None, None, None, "a", "b", "c"]), None if rng.random() < 0.9999 else rng.randrange(10**6)]
        if i % 3 == 0:
            rows.append(("t7", "2026-01-01 00:00", i, *value))
        elif i % 3 == 1:
            rows.append((f"t{rng.choice([7, 8])}", None, i, *value))
        else:
            rows.append((rng.choice([f"t{rng.randrange(400)}", None, "t7"]), f"2026-0{rng.randrange(1, 9)}-11 0{rng.randrange(9)}:00", i, *value))
    return rows


def test_last_known_value_across_ranges(spark, hot_moment):
    frame = spark.createDataFrame(hot_moment, "k string, m string, i int, v string, w int").withColumn("m", F.col("m").cast("timestamp")).repartition(8)
    assert largest_share(with_range(frame, ["k", "m", "i", "v", "w"])) < 0.1
    got = {r.i: (r.previous_v, r.previous_w) for r in with_previous_known(frame, "k", "m", "i", ["v", "w"]).collect()}
    last = {}
    for k, _, i, v, w in sorted(hot_moment, key=lambda r: (r[0] or "", r[1] or "", r[2])):
        known = last.get(k, (None, None))
        assert got[i] == known, (k, i)
        last[k] = (v if v is not None else known[0], w if w is not None else known[1])


def test_more_partitions_give_more_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1000")
    try:
        assert n_ranges(spark.range(1)) == 2000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
