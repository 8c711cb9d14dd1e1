"""Every query with SQL against DuckDB, and small runs of all."""

import os

import duckdb
import pytest

import corpus_pipeline
from tenurekit.llm import queries, sql

FOLDER = "/root/testdata/sf0.001"
KNOWN = queries.queries() | {"pipeline": corpus_pipeline.run}
SQL = sql.oracle_sql() | {"pipeline": corpus_pipeline.ORACLE_SQL}


def _plain(frame):
    columns = sorted(frame.columns)
    cells = [tuple(None if v is None or v != v else v.item() if hasattr(v, "item") else v for v in row) for row in frame[columns].itertuples(index=False, name=None)]
    return columns, sorted(cells, key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = _plain(KNOWN[name](spark, FOLDER).toPandas()), _plain(duck.execute(SQL[name]).fetchdf())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_pipeline_keeps_the_columns_until_the_last_stage(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == names


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0 and docs.columns[-2:] == ["shard", "slot"]
