"""CSV exports to typed tables.

Multi-line files are read in splits (``split_csv``). Everything after the parse is a single projection, and what the reports
count is counted by the write. Exports land side by side.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenurekit.config import TableNames
from tenurekit.sources.builds import Build, build_all
from tenurekit.sources.casts import casts_for
from tenurekit.sources.split_csv import read_split_csv
from tenurekit.sources.tables import write_counted


def read_csv_strings(spark: SparkSession, path: str, multi_line: bool = True, split: bool = False) -> DataFrame:
    """All columns as strings. ``multi_line=False`` gives the plain scan; ``split=True`` reads a large multi-line file in many
    tasks, rows in no particular order; without it one task reads a file, and its quoting need not be regular."""
    if multi_line and split:
        return read_split_csv(spark, path)
    reader = spark.read.option("header", True).option("inferSchema", False)
    if multi_line:
        reader = reader.option("multiLine", True).option("escape", '"')
    return reader.csv(path)


def with_ingest_metadata(df: DataFrame, path: str, source: str | None = None) -> DataFrame:
    added = {"_ingested_at": F.current_timestamp(), "_source_file": F.lit(path)}
    if source is not None:
        added["_source_table"] = F.lit(source)
    return df.withColumns(added)


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """One projection; text that does not parse (the empty string too) becomes null, not an error."""
    return df.select(
        *(F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns)
    )


def null_counts(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """One row: ``n_rows`` and the number of nulls in each column, in a single pass."""
    return df.agg(
        F.count("*").alias("n_rows"),
        *(F.count_if(F.col(c).isNull()).alias(c) for c in columns),
    )


def null_profile(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Long form of :func:`null_counts`: one row per column."""
    columns = list(columns)
    return null_counts(df, columns).unpivot("n_rows", columns, "column_name", "n_null")


def ingest_csv(
    spark: SparkSession,
    path: str,
    target: str,
    *,
    source: str | None = None,
    types: Mapping[str, str] | None = None,
    multi_line: bool = True,
    split: bool = True,
    fmt: str = "parquet",
    storage_path: str | None = None,
) -> dict[str, int]:
    """Land one export as a table. Returns ``n_rows`` and the nulls of each typed column, counted by the write."""
    raw = with_ingest_metadata(read_csv_strings(spark, path, multi_line, split), path, source)
    typed = cast_columns(raw, types or {})
    counts = {"n_rows": F.count("*")} | {c: F.count_if(F.col(c).isNull()) for c in typed.columns if c in (types or {})}
    return write_counted(typed, target, counts, fmt=fmt, storage_path=storage_path)


def ingest_exports(
    spark: SparkSession,
    names: TableNames,
    tables: Iterable[str],
    *,
    source_schema: str = "source",
    files: Mapping[str, str] | None = None,
    fmt: str = "parquet",
    storage_root: str | None = None,
    at_once: int = 4,
) -> DataFrame:
    """Land several exports side by side; the report has one row per typed column of each table.

    No export is parsed and no table scanned a second time. An export that fails has one row with its ``error`` instead, and
    the others land.
    """

    def landing(name: str) -> Build:
        def run() -> dict[str, int]:
            return ingest_csv(
                spark,
                (files or {}).get(name, names.landing_file(name)),
                names.table("bronze", name),
                source=f"{source_schema}.{name}",
                types=casts_for(name),
                fmt=fmt,
                storage_path=f"{storage_root}/{name}" if storage_root else None,
            )

        return Build(run)

    rows = []
    for name, outcome in build_all(spark, {name: landing(name) for name in tables}, at_once).items():
        if outcome.error:
            rows.append((name, None, None, None, outcome.error))
        else:
            rows += [(name, c, outcome.result["n_rows"], n, None) for c, n in outcome.result.items() if c != "n_rows"]
    return spark.createDataFrame(rows, "table_name string, column_name string, n_rows bigint, n_null bigint, error string")
