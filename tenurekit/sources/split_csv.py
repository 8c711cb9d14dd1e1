"""Multi-line CSV files of any size, read by many tasks.

Whether a line feed ends a record depends on how many quotes come before it in the file, which is why a reader of multi-line
CSV takes a file as one task. Here a file is read as lines, in splits; each split reports the parity of its quotes, the
parities are summed over the splits before it (one row a split), and then every line knows whether it begins a record. Lines
that are whole records are parsed where they are, without an exchange; only the pieces of records with line feeds are brought
together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OPTIONS = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}


def _header(spark: SparkSession, path: str) -> list[str]:
    """Column names; the header must be one line."""
    return spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(path).columns


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, at, line, quotes): each line with its place. Lines of a split are read in order by one task."""
    lines = spark.read.option("lineSep", "\n").text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("line"),
        quotes.alias("quotes"),
    )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``own``, the quotes before each line in its split, and ``is_header``. One task reads a split's lines, in order."""
    begun: dict[tuple[str, int], int] = {}
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        files, splits = batch.column("file").dictionary_encode(), batch.column("split").to_numpy()
        quotes, codes = batch.column("quotes").to_numpy().astype(np.int64), files.indices.to_numpy()
        own, header = np.cumsum(quotes) - quotes, np.zeros(n, bool)
        starts = np.flatnonzero(np.r_[True, (splits[1:] != splits[:-1]) | (codes[1:] != codes[:-1])])
        for start, end in zip(starts, np.r_[starts[1:], n]):
            key = (files.dictionary[codes[start]].as_py(), int(splits[start]))
            header[start] = key[1] == 0 and key not in begun
            own[start:end] += begun.get(key, 0) - own[start]
            begun[key] = int(own[end - 1] + quotes[end - 1])
        columns = [batch.column(c) for c in ("file", "split", "at", "line", "quotes")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(own), pa.array(header)], ["file", "split", "at", "line", "quotes", "own", "is_header"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of each record after the file's header line."""
    lines = _numbered(spark, path)
    before_split = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # one row a split

    def carried(rows: DataFrame, measure: str) -> DataFrame:
        """What the splits before each split of a file add up to."""
        sums = rows.groupBy("file", "split").agg(F.sum(measure).alias("n"))
        return sums.select("file", "split", F.coalesce(F.sum("n").over(before_split), F.lit(0)).alias("carried"))

    in_split = Window.partitionBy("file", "split").orderBy("at")
    counted = lines.mapInArrow(_counted, "file string, split bigint, at bigint, line string, quotes int, own bigint, is_header boolean")
    placed = counted.join(F.broadcast(carried(lines, "quotes")), ["file", "split"])  # one row a split
    before = F.col("own") + F.col("carried")
    marked = placed.where("not is_header").select(
        "file", "split", "at", "line", (before % 2 == 0).alias("starts"), ((before + F.col("quotes")) % 2 == 0).alias("ends")
    )
    whole = marked.where("starts and ends").select("file", F.col("line").alias("text"))
    # a piece's record is the number of such records begun by then in the file; splits carry counts as they do parities
    pieces = marked.where("not (starts and ends)").withColumn("begins", F.col("starts").cast("bigint"))
    numbered = pieces.withColumn("_begun", F.sum("begins").over(in_split)).join(carried(pieces, "begins"), ["file", "split"])
    number = F.col("carried") + F.col("_begun")
    parts = F.sort_array(F.collect_list(F.struct("split", "at", "line")))
    glued = numbered.groupBy("file", number.alias("record")).agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("text"))
    return whole.unionByName(glued.select("file", "text"))


def read_split_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, as the multi-line reader gives them for well-formed files (quotes doubled inside quoted fields,
    one header line a file); rows come in no particular order. Blank lines outside quotes are skipped."""
    columns = _header(spark, path)
    text = F.regexp_replace("text", "\r$", "").alias("text")
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    body = records(spark, path).select(text).where("text <> ''")
    return body.select(F.from_csv("text", schema, _OPTIONS).alias("row")).select("row.*")
