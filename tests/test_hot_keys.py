"""One key holds a third of all rows: results stay whole and exact."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tenurekit.operators import cohort, deferral, features, labels, lookback

HOT = "s0"


@pytest.fixture(scope="module")
def world(spark, make_terms, make_subs, cal):
    rng = random.Random(11)
    subs = [f"s{i}" for i in range(40)]
    start = {s: date(2026, 1, 1) + timedelta(days=rng.randrange(60)) for s in subs}
    cancel = {s: start[s] + timedelta(days=rng.randrange(5, 120)) if rng.random() < 0.6 else None for s in subs}
    terms = make_terms(*((s, start[s].isoformat(), cancel[s] and cancel[s].isoformat(), None) for s in subs))

    def pick():
        return HOT if rng.random() < 1 / 3 else rng.choice(subs)

    def when(s):
        return datetime.combine(start[s], datetime.min.time()) + timedelta(days=rng.randrange(-5, 150), hours=rng.randrange(24))

    invoices = []
    for i in range(3000):
        s = pick()
        made = when(s)
        failed = rng.random() < 0.3
        failed_at = made + timedelta(hours=rng.randrange(60)) if failed and rng.random() < 0.9 else None
        invoices.append((s, f"{s}-t", made, failed, rng.random() < 0.1, not failed, rng.random() < 0.1, rng.choice([None, 1, 2, 8]), failed_at, made, None))
    events = []
    for i in range(1500):
        s = pick()
        at = when(s)
        old = at + timedelta(days=rng.randrange(10)) if rng.random() < 0.95 else None
        new = old and old + timedelta(days=rng.randrange(40))
        name = rng.choice(["term_renewal_time_changed", "upcoming_term_renewal_notified", "canceled"])
        events.append((s, name, rng.choice(["CHANGED_BY_USER", "CHANGED_BY_SYSTEM"]), at, old, new))
    plans = []
    for i in range(900):
        s = pick()
        plans.append((s, f"{s}-t", i + 1, when(s), *(rng.choice([None, "a", "b"]) for _ in range(3)), rng.choice([4, 8, None]), "x"))
    frames = {
        "terms": terms,
        "invoices": spark.createDataFrame(invoices, """subscription_id string, subscription_term_id string, created_at timestamp,
            is_failed boolean, is_delinquent boolean, is_paid boolean, is_refunded boolean, num_charges int, failed_at timestamp,
            paid_at timestamp, refunded_at timestamp"""),
        "events": spark.createDataFrame(events, """subscription_id string, event_name string, changed_by string,
            occurred_at timestamp, old_renewal_at timestamp, new_renewal_at timestamp"""),
        "plans": spark.createDataFrame(plans, """subscription_id string, subscription_term_id string, plan_term_number int,
            plan_term_started_at timestamp, drug_name string, regimen string, drug_strength string, monthly_dose int,
            starting_fulfillment_type string""").withColumn("term_months", F.lit(1)),
    }
    members = cohort.cohort_terms(terms, make_subs(*subs), cal)
    frames["bounds"] = labels.snapshot_bounds(members, cal)
    frames["snapshots"] = [r.asDict() for r in labels.weekly_snapshots(frames["bounds"], cal).collect()]
    raw = {"invoices": invoices, "events": events, "plans": plans, "start": start}
    return frames, raw


def in_window(snapshot, moment, window):
    return 0 <= (snapshot["snapshot_date"] - moment.date()).days <= window


def averages(pairs):
    sums = {}
    for key, value in pairs:
        total, n = sums.get(key, (0, 0))
        sums[key] = (total + value, n + 1)
    return {key: total / n for key, (total, n) in sums.items()}


def week_key(s):
    return s["week_number"], "churned" if s["label"] == 1 else "retained"


def test_invoice_series(world, cal):
    frames, raw = world
    got = features.invoice_series(frames["invoices"], frames["bounds"], cal, 14, 26).collect()
    hits = [(week_key(s), i) for s in frames["snapshots"] if s["week_number"] <= 26
            for i in raw["invoices"] if i[1] == s["subscription_term_id"] and in_window(s, i[2], 14)]
    failure = averages((k, int(i[3])) for k, i in hits)
    charges = averages((k, i[7]) for k, i in hits if i[7] is not None)
    assert {(r.week_number, r.group): r.failure_rate for r in got} == pytest.approx(failure)
    assert {(r.week_number, r.group): r.avg_charges for r in got if r.avg_charges is not None} == pytest.approx(charges)


def test_deferral_series_keeps_snapshots_without_events(world, cal):
    frames, raw = world
    got = features.deferral_series(frames["events"], frames["bounds"], cal, 14, 26).collect()
    rows = []
    for s in frames["snapshots"]:
        if s["week_number"] > 26:
            continue
        days = {}
        for e in raw["events"]:
            if e[0] == s["subscription_id"] and e[1] == lookback.RENEWAL_MOVED and e[2] == lookback.BY_USER and e[4] and in_window(s, e[3], 14):
                n, moved = days.get(e[3].date(), (0, 0))
                days[e[3].date()] = (n + 1, moved + (e[5].date() - e[4].date()).days)
        rows += [(week_key(s), 1, n, moved) for n, moved in days.values()] or [(week_key(s), 0, 0, 0)]
    for column, position in (("has_deferred", 1), ("avg_num_deferrals", 2), ("avg_days_deferred", 3)):
        want = averages((row[0], row[position]) for row in rows)
        assert {(r.week_number, r.group): r[column] for r in got} == pytest.approx(want)


def test_plan_changes(world, cal):
    frames, raw = world
    got = features.plan_change_series(frames["plans"], frames["bounds"], cal, 14, 26).collect()
    by_term = {}
    for p in sorted(raw["plans"], key=lambda p: (p[1], p[3], p[2])):
        by_term.setdefault(p[1], []).append(p)
    marked = []
    for rows in by_term.values():
        known = None
        for p in rows:
            marked.append((p, int(p[2] > 1 and p[4] is not None and known is not None and p[4] != known)))
            known = p[4] if p[4] is not None else known
    want = averages((week_key(s), c) for s in frames["snapshots"] if s["week_number"] <= 26
                    for p, c in marked if p[1] == s["subscription_term_id"] and in_window(s, p[3], 14))
    assert {(r.week_number, r.group): r.drug_change for r in got} == pytest.approx(want)


def test_failed_invoices_known_at_start(world, spark):
    frames, raw = world
    starts = spark.createDataFrame([(f"{s}-t", d) for s, d in raw["start"].items()], "subscription_term_id string, term_started_at date")
    got = {r.subscription_term_id: r.failed_invoice_count for r in features.failed_invoices_at_start(frames["invoices"], starts).collect()}
    want = {}
    for i in raw["invoices"]:
        limit = datetime.combine(raw["start"][i[0]], datetime.min.time())
        if i[2] <= limit and (i[8] is None or i[8] <= limit):
            want[i[1]] = want.get(i[1], 0) + int(i[3])
    assert got == want


@pytest.mark.parametrize("strict", [False, True])
def test_feature_table_sees_nothing_after_the_snapshot(world, spark, cal, strict):
    frames, raw = world
    people = spark.createDataFrame([(s, "web", "crm") for s in raw["start"]],
                                   "subscription_id string, first_platform string, first_channel_grouping string")
    profile = features.term_profile(frames["bounds"], people)
    days = features.activity_days(frames["bounds"], frames["invoices"], frames["events"], frames["plans"], cal)
    got = features.snapshot_feature_table(profile, days, cal, (7, 30), strict)
    rows = {(r.subscription_term_id, r.week_number): r for r in got.collect()}
    assert len(rows) == len(frames["snapshots"])
    for s in frames["snapshots"]:
        row = rows[s["subscription_term_id"], s["week_number"]]
        for w in (7, 30):
            mine = [i for i in raw["invoices"] if i[1] == s["subscription_term_id"] and in_window(s, i[2], w)]
            failed = [i for i in mine if i[3] and (not strict or (i[8] and i[8].date() <= s["snapshot_date"]))]
            assert row[f"invoices_{w}d"] == len(mine)
            assert row[f"failed_{w}d"] == len(failed)
            moved = [e for e in raw["events"] if e[0] == s["subscription_id"] and e[1] == lookback.RENEWAL_MOVED
                     and e[2] == lookback.BY_USER and in_window(s, e[3], w)]
            assert row[f"deferrals_{w}d"] == len(moved)
            started = [p for p in raw["plans"] if p[1] == s["subscription_term_id"] and in_window(s, p[3], w)]
            assert row[f"plan_starts_{w}d"] == len(started)


def test_plan_at_snapshot_is_the_last_one_started(world, cal):
    frames, raw = world
    got = features.plan_at_snapshots(frames["bounds"], frames["plans"], cal).collect()
    rows = {(r.subscription_term_id, r.snapshot_date): (r.drug_name, r.regimen) for r in got}
    assert len(got) == len(rows) == len(frames["snapshots"])
    for s in frames["snapshots"]:
        known = [p for p in raw["plans"] if p[1] == s["subscription_term_id"] and p[3].date() <= s["snapshot_date"]]
        current = max(known, key=lambda p: (p[3], p[2])) if known else (None,) * 6
        assert rows[s["subscription_term_id"], s["snapshot_date"]] == (current[4], current[5])


def test_renewals_count_every_paid_invoice_once(world, cal):
    frames, raw = world
    outcomes = deferral.renewal_outcomes(frames["events"], frames["invoices"], cal)
    got = {r.subscription_id: r.n_paid_after for r in outcomes.collect()}
    latest = {}
    for e in raw["events"]:
        if e[1] == lookback.RENEWAL_MOVED and e[2] == lookback.BY_USER and e[5]:
            latest[e[0]] = max(latest.get(e[0], e[5]), e[5])
    want = {s: sum(1 for i in raw["invoices"] if i[0] == s and i[5] and i[2].date() >= t.date())
            for s, t in latest.items() if t <= datetime(2026, 5, 31)}
    assert got == want


@pytest.fixture
def splitting(spark):
    """Joins without broadcasts, and small enough limits for AQE to split hot keys of test inputs."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key, None) for key in small}
    for key, value in small.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_raw_rows_of_a_hot_key_are_split(spark, splitting, capsys):
    """Restricting raw rows to a cohort planned in the same query: AQE may still split the hot key."""
    hot = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000)
    rows = spark.range(0, 300_000, 1, 8).select(hot.alias("subscription_id"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
    terms = spark.range(5000).select(F.col("id").alias("subscription_id"), (F.col("id") % 2).alias("kept"))
    people = spark.range(5000).select(F.col("id").alias("subscription_id"))
    members = terms.filter("kept = 1").join(people, "subscription_id", "left_semi")
    kept = cohort.restrict_to(rows, members).agg(F.count("x"), F.max("x"))
    want = sum(1 for i in range(300_000) if (7 if i % 3 == 0 else i % 5000) % 2 == 1)
    assert kept.collect()[0][0] == want
    kept.explain("simple")
    assert "skew=true" in capsys.readouterr().out


def test_terms_of_a_hot_subscription_are_split(spark, splitting, cal, capsys):
    """A third of all terms on one subscription: its bounds meet the days of its events in several tasks."""
    hot = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000)
    terms = spark.range(0, 60_000, 1, 8).select(
        hot.alias("subscription_id"), F.sha2(F.col("id").cast("string"), 256).alias("subscription_term_id"), F.lit(1).alias("term_number"),
        F.to_timestamp(F.lit("2026-03-01")).alias("term_started_at"), F.lit(None).cast("timestamp").alias("cancel_requested_at"),
        F.lit(None).cast("timestamp").alias("term_ended_at"),
    )
    people = spark.range(5000).select(F.col("id").alias("subscription_id"), F.lit(True).alias("is_paid"), F.lit(True).alias("is_activated"))
    bounds = labels.snapshot_bounds(cohort.cohort_terms(terms, people, cal), cal)
    daily = spark.range(5000).select(F.col("id").alias("subscription_id"), F.to_date(F.lit("2026-03-10")).alias("day"), F.lit(1).alias("n"))
    spread = lookback.spread_over_snapshots(daily, bounds, "subscription_id", cal, 7).agg(F.sum("n"), F.count_distinct("subscription_term_id"))
    assert tuple(spread.collect()[0]) == (60_000, 60_000)
    spread.explain("simple")
    assert "skew=true" in capsys.readouterr().out


def test_spread_is_bounded_per_day(world, cal):
    frames, _ = world
    daily = lookback.invoice_days(frames["invoices"])
    spread = lookback.spread_over_snapshots(daily, frames["bounds"], "subscription_term_id", cal, 14)
    most = spread.groupBy("subscription_term_id", "day").count().agg(F.max("count")).first()[0]
    assert most <= 14 // 7 + 1


def test_hot_rows_are_split_without_a_sort(spark, splitting, capsys):
    """Many rows of a hot key pass a hash table of the cohort's keys; where they come out of a join by the key, that one is split too."""
    hot = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000)
    rows = spark.range(0, 300_000, 1, 8).select(hot.alias("subscription_id"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
    terms = spark.range(5000).select(F.col("id").alias("subscription_id"), (F.col("id") % 2).alias("kept"))
    people = spark.range(5000).select(F.col("id").alias("subscription_id"))
    members = terms.filter("kept = 1").join(people, "subscription_id", "left_semi")
    want = sum(1 for i in range(300_000) if (7 if i % 3 == 0 else i % 5000) % 2 == 1)
    for given in (rows, rows.join(people.withColumn("y", F.rand(1)), "subscription_id")):
        kept = cohort.restrict_to(given, members, hashed=True).agg(F.count("x"), F.max("x"))
        assert kept.collect()[0][0] == want
        kept.explain("simple")
        final = capsys.readouterr().out.split("== Initial Plan ==")[0]
        assert any("ShuffledHashJoin" in line and "skew=true" in line.lower() for line in final.splitlines()), final
