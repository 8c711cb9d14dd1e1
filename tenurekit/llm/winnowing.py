"""Benchmark decontamination by winnowing.

The fingerprint of ten consecutive words is the least hash of their six 5-grams (the minimum of each sliding window of
k-grams). Any shared span of ten words has the same fingerprint on both sides, so none is missed. Documents keep only
fingerprints that a bit table of the items' fingerprints lets through; these hits are extended to their whole windows
by two independent 64-bit hashes, which a join compares with the items' windows. Items of fewer than ten words are one
window of their own length.

Words are runs of letters and digits of any script (bytes from 0x80 count as letters), A-Z as a-z.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenurekit.llm.batches import ids_and_texts, rows
from tenurekit.llm.bits import bit_table, in_table
from tenurekit.llm.scratch import staged
from tenurekit.llm.words import LETTERS_DIGITS, grams, word_hashes

SPAN = 10
K = 5
#: Size of the bit table of fingerprints: 2 MB for any number of items.
TABLE_BITS = 24
_SECOND = 0x5851F42D4C957F2D


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    """The least 5-gram hash of each window of ten words."""
    own = grams(hashes, K)
    n = len(hashes) - SPAN + 1
    if n <= 0:
        return own[:0]
    least = own[:n].copy()
    for j in range(1, SPAN - K + 1):
        np.minimum(least, own[j : j + n], out=least)
    return least


_WINDOWS = "item_id bigint, n_words int, print bigint, first bigint, second bigint"


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in ids_and_texts(batches):
        hashes, offsets = word_hashes(texts, LETTERS_DIGITS)
        for item, lo, hi in zip(ids, offsets[:-1], offsets[1:], strict=True):
            own = hashes[lo:hi]
            if len(own):
                n = min(SPAN, len(own))
                first = grams(own, n)
                found = fingerprints(own) if n == SPAN else first
                yield rows(_WINDOWS, item_id=[item] * len(first), n_words=np.full(len(first), n), print=found.view(np.int64), first=first.view(np.int64), second=grams(own, n, _SECOND).view(np.int64))


_MET = "row bigint, doc_id bigint, doc_words bigint, start bigint, n_words int, first bigint, second bigint"


def _doc_windows(table: object, short: list[int]) -> Callable:
    """A row for each document, and a row for each window whose fingerprint the table lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for ids, texts in ids_and_texts(batches):
            hashes, offsets = word_hashes(texts, LETTERS_DIGITS)
            counts = np.diff(offsets)
            yield rows(_MET, row=np.arange(row, row + len(ids)), doc_id=ids, doc_words=counts)
            for n in [*short, SPAN]:
                # over the words of all texts at once; windows that run over a text's end are left out
                found = fingerprints(hashes) if n == SPAN else grams(hashes, n)
                met = np.flatnonzero(in_table(found, table.value))
                text = np.searchsorted(offsets, met, side="right") - 1
                inside = met + n <= offsets[text + 1]
                met, text = met[inside], text[inside]
                if len(met):
                    spread = hashes[met[:, None] + np.arange(n)].ravel()
                    first, second = (grams(spread, n, salt)[::n] for salt in (0, _SECOND))
                    yield rows(_MET, row=row + text, start=met - offsets[text], n_words=np.full(len(met), n), first=first.view(np.int64), second=second.view(np.int64))
            row += len(ids)

    return run


def benchmark_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, spans): every row of docs as (row, doc_id, n_words), and every (row, start, length, item_id) found.

    ``row`` tells repeated rows apart. Null and empty texts have no words and no spans, on either side; items without
    id are found too, with a null item_id. Other columns are ignored. Empty tables give empty results.
    """
    spark = docs.sparkSession
    items = items.select(F.col(item_id).cast("bigint"), F.col(item_text).cast("string")).mapInArrow(_item_windows, _WINDOWS)
    windows = staged(items.distinct(), "winnow-items")
    short = [r[0] for r in windows.where(F.col("n_words") < SPAN).select("n_words").distinct().collect()]  # 9 values at most
    table = spark.sparkContext.broadcast(bit_table(windows, "print", TABLE_BITS))
    docs = docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string"))
    met = staged(docs.mapInArrow(_doc_windows(table, sorted(short)), _MET), "winnow-docs")
    found = met.where("first is not null").select("row", "start", "n_words", "first", "second")
    spans = found.join(windows.select("n_words", "first", "second", "item_id"), ["n_words", "first", "second"])
    return (
        met.where("doc_words is not null").select("row", "doc_id", F.col("doc_words").alias("n_words")),
        spans.select("row", "start", F.col("n_words").cast("bigint").alias("length"), "item_id"),
    )


def contamination(docs: DataFrame, items: DataFrame, **columns: str) -> DataFrame:
    """Of every row of docs: row, doc_id, n_words, n_hit, n_items, item_ids (sorted as strings) and contaminated."""
    documents, spans = benchmark_spans(docs, items, **columns)
    before = Window.partitionBy("row").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    fresh = end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0)))
    hit = spans.withColumn("fresh", F.greatest(fresh, F.lit(0))).groupBy(F.col("row").alias("hit_row"))
    hit = hit.agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    all_rows = documents.join(hit, documents.row == hit.hit_row, "left")
    item_ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return all_rows.select("row", "doc_id", "n_words", n_hit.alias("n_hit"), F.size(item_ids).cast("bigint").alias("n_items"), item_ids.alias("item_ids"), (n_hit > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs in which no item is found, with all their columns. Rows are told apart by a hash of id and text."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("doc_id", "text").alias("k"), "text")
    met = contamination(packed, items, doc_id="k").where("contaminated").select(F.col("doc_id").alias("k"))
    return packed.join(staged(met.distinct(), "winnow-met"), "k", "left_anti").select("row.*")
