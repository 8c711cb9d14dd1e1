"""Every analysis against independent SQL in another engine, over the same folder."""

import math

import duckdb
import pytest
from conftest import DATA

import __spark_entry__ as entry
from tenurekit.plans import analyses

TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels
    conversations""".split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
    "timestamp": "TIMESTAMP",
}
QUERIES, ORACLES = ({n: x for n, x in given.items() if n in analyses()} for given in (entry.queries(), entry.oracle_sql()))


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


def comparable(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    keyed = [tuple(comparable(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(keyed, key=repr)


def test_every_analysis_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_every_line_item_is_one_plan_term(spark, duck):
    """Nothing of the sales tables is cut: line items, parts and orders all come through."""
    source = entry._lake(spark, DATA).source
    plans, base = source["subscription_plan_terms"], source["base"]
    n_lines, n_orders = duck.execute("SELECT count(*), count(DISTINCT l_orderkey) FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)").fetchone()
    assert base.count() == duck.execute("SELECT count(*) FROM orders").fetchone()[0]
    assert plans.count() == n_lines == plans.select("subscription_plan_term_id").distinct().count()
    assert plans.where("is_latest_plan_term").count() == n_orders == plans.select("subscription_id").distinct().count()
    numbers = plans.groupBy("subscription_id").agg({"plan_term_number": "max", "*": "count"})
    assert numbers.where("`max(plan_term_number)` <> `count(1)`").count() == 0
    assert source["subscription_invoices"].count() == duck.execute("SELECT count(*) FROM lineitem").fetchone()[0]
    assert source["subscription_plan_types"].count() == duck.execute("SELECT count(*) FROM part").fetchone()[0]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    ours = canonical(df.columns, df.collect())
    types = {row[0]: row[1] for row in duck.execute(f"DESCRIBE {ORACLES[name]}").fetchall()}
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    cursor = duck.execute(ORACLES[name])
    theirs = canonical([c[0] for c in cursor.description], cursor.fetchall())
    assert ours == theirs


def test_entry_runs(spark):
    assert [r["cadence"] for r in entry.entry(spark).collect()] == [1, 3, 6]
