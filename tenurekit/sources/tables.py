"""Table scans, replacing sinks and small reports over many tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Formats whose own overwrite is one transaction.
TRANSACTIONAL = ("delta", "iceberg")


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def write_table(
    df: DataFrame,
    target: str,
    *,
    fmt: str = "parquet",
    storage_path: str | None = None,
    sort_by: Sequence[str] = (),
    seen: Observation | None = None,
    counts: Mapping[str, Column] | None = None,
) -> str:
    """Create or replace a table; its schema may change between runs.

    Files go to a fresh place below ``storage_path`` and the table is pointed there once all are written: a write that fails
    leaves the rows that were there, and readers never see half a table. Earlier files stay where they are.

    ``sort_by`` clusters the files for later pruning. Ranges are cut on the whole key list, so one hot leading value is still
    spread over many files. Drawing the ranges reads the input's last exchanges a second time; no copy of the rows is written
    for it. ``seen`` observes ``counts`` above the sort, where each row passes once.
    """
    spark = df.sparkSession
    if sort_by:
        df = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
    if seen is not None:
        df = df.observe(seen, *(value.alias(name) for name, value in (counts or {}).items()))
    if fmt in TRANSACTIONAL:
        writer = df.write.format(fmt).mode("overwrite").option("overwriteSchema", "true")
        if storage_path is not None:
            writer = writer.option("path", storage_path)
        writer.saveAsTable(target)
        return target
    root = storage_path or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{target.replace('.', '/')}"
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    _point(spark, target, _written(df, path, fmt), path, fmt)
    return target


def _written(df: DataFrame, path: str, fmt: str) -> DataFrame:
    writer = df.write.format(fmt)
    if fmt == "parquet":
        writer = writer.option("compression", "zstd")
    writer.save(path)
    return df.sparkSession.read.format(fmt).schema(df.schema).load(path)


def _point(spark: SparkSession, target: str, df: DataFrame, path: str, fmt: str) -> None:
    """Make ``target`` the table of the files in ``path``; only the catalog changes."""
    columns = [(f.name, f.dataType) for f in df.schema]
    if spark.catalog.tableExists(target):
        if [(f.name, f.dataType) for f in spark.table(target).schema] == columns and _provider(spark, target) == fmt:
            spark.sql(f"ALTER TABLE {target} SET LOCATION '{path}'")
            spark.catalog.refreshTable(target)
            return
        spark.sql(f"DROP TABLE {target}")
    spark.catalog.createTable(target, path=path, source=fmt, schema=df.schema)


def _provider(spark: SparkSession, target: str) -> str:
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {target}").where("col_name = 'Provider'").first()
    return described.data_type.lower() if described else ""


def write_counted(df: DataFrame, target: str, counts: Mapping[str, Column], **options) -> dict[str, int]:
    """Write a table and return ``counts`` (aggregates by name) as the write itself saw them: no second scan."""
    seen = Observation(f"write-{uuid.uuid4().hex}")
    write_table(df, target, seen=seen, counts=counts, **options)
    return seen.get


def write_bucketed(df: DataFrame, target: str, key: str, *, buckets: int, storage_path: str | None = None) -> DataFrame:
    """A stored copy laid out by hash of ``key``: joins and groups by it read the table without an exchange.

    Rows are exchanged by the same hash first, so each task writes the one file of a bucket.
    """
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite").format("parquet")
    if storage_path is not None:
        writer = writer.option("path", storage_path)
    writer.saveAsTable(target)
    return read_table(df.sparkSession, target)


def copy_table(spark: SparkSession, source: str, target: str, **write_options) -> str:
    """Pass a table from one layer to the next unchanged."""
    return write_table(read_table(spark, source), target, **write_options)


def row_counts(spark: SparkSession, tables: Iterable[str]) -> DataFrame:
    """One row per table: its row count, or why it could not be read."""
    parts = []
    for name in tables:
        try:
            counted = read_table(spark, name).agg(F.count("*").alias("n_rows"))
            error = F.lit(None).cast("string")
        except PySparkException as failure:
            counted = spark.range(1).select(F.lit(None).cast("bigint").alias("n_rows"))
            error = F.lit(failure.getCondition() or type(failure).__name__)
        parts.append(counted.select(F.lit(name).alias("table_name"), "n_rows", error.alias("error")))
    return reduce(DataFrame.unionByName, parts)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def order_report(table: DataFrame, sort_by: Sequence[str]) -> DataFrame:
    """One row that reads a clustered table's order back: ``n_rows``, rows below their predecessor in the same file
    (``n_unsorted``), and files whose range of keys overlaps that of an earlier file (``n_overlapping``).

    Files are scanned row by row in storage order, so ``n_unsorted`` is counted per part of a file that one task reads.
    """
    key = F.struct(*sort_by)
    placed = table.select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), key.alias("key"))
    part = F.shiftright("at", 33)  # the number of the task that read the row
    in_file = Window.partitionBy("file", part).orderBy("at")
    checked = placed.withColumn("unsorted", F.coalesce(F.col("key") < F.lag("key").over(in_file), F.lit(False)))
    files = checked.groupBy("file").agg(F.count("*").alias("n"), F.count_if("unsorted").alias("unsorted"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    by_range = Window.orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    overlapping = files.withColumn("overlapping", F.coalesce(F.col("lo") < F.max("hi").over(by_range), F.lit(False)))
    return overlapping.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("unsorted"), F.lit(0)).alias("n_unsorted"), F.count_if("overlapping").alias("n_overlapping")
    )
