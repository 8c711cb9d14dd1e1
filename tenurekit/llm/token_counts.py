"""Exact token counts by two tiers of pre-token lengths; no pre-token is shuffled.

A byte-level BPE never merges across pre-tokens, so a text's token count is the sum of its pre-tokens' lengths. The most
frequent pre-tokens of about SAMPLE texts, drawn at random, go to every task as one bounded table; it only saves time. The others
are encoded where they occur and kept in a bounded cache of the worker, which its later tasks find again. Whole texts go to
the library where they hold one of its special strings or a character that it and the ``regex`` module put in
different classes, and all texts where the file's pre-tokenizer is not the one that the pattern stands for.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenurekit.llm.batches import rows

#: Entries of the table that every task gets, texts they are taken from, and leaders that each of those reports.
TABLE, SAMPLE, LEADERS = 32_768, 4_096, 512
#: Lengths a worker keeps.
CACHED = 500_000
#: Longer pre-tokens are not kept.
LONGEST = 64
#: The pre-tokenizer's pattern (fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _pattern():
    import regex

    return regex.compile(PATTERN)


def _strings(batches: Iterator[pa.RecordBatch], at_once: int = 256) -> Iterator[tuple[list, list[str]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, at_once):
            yield batch.column(0).slice(at, at_once).to_pylist(), [t or "" for t in batch.column(1).slice(at, at_once).to_pylist()]


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pattern = _pattern()
    for _, texts in _strings(batches):
        best = [(p, n) for text in texts for p, n in Counter(pattern.findall(text)).most_common(LEADERS) if len(p) <= LONGEST]
        if best:
            yield rows("piece string, found bigint", piece=[p for p, _ in best], found=[n for _, n in best])


def sampled_leaders(docs: DataFrame) -> DataFrame:
    """(piece, found) of about SAMPLE texts, LEADERS rows of each at most. docs: doc_id and text."""
    return docs.where(F.rand(6) < SAMPLE / max(1, docs.count())).mapInArrow(_leaders, "piece string, found bigint")


def most_frequent(docs: DataFrame) -> list[str]:
    """The TABLE most frequent leaders, added up by Spark: the driver gets no more than these."""
    found = sampled_leaders(docs).groupBy("piece").agg(F.sum("found").alias("found"))
    return [r.piece for r in found.orderBy(F.desc("found"), "piece").limit(TABLE).collect()]


def splits_by_pattern(spec: dict) -> bool:
    """Whether a tokenizer's file asks for the pattern's pre-tokens and for nothing that changes the text or merges across them."""
    split = spec.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
    model = spec.get("model") or {}
    return plain and not spec.get("normalizer") and model.get("type", "BPE") == "BPE" and not model.get("dropout")


#: Lengths that this worker found, by tokenizer; tasks that it runs later go on with them.
_FOUND: dict[str, dict[str, int]] = {}


class _Counter:
    """Token counts of texts, with the table, the cache and the library of one worker."""

    def __init__(self, spec: str, table: dict[str, int]) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        read = json.loads(spec)
        self.by_pattern = splits_by_pattern(read)
        self.special = [x["content"] for x in read.get("added_tokens") or []]
        self.pattern, self.table = _pattern(), table
        self.own = _FOUND.setdefault(hashlib.sha256(spec.encode()).hexdigest(), {})
        self.agreed: dict[str, bool] = {}

    def plain(self, text: str) -> bool:
        """Whether the pattern splits the text as the library does."""
        if not self.by_pattern or any(s in text for s in self.special):
            return False
        if text.isascii():
            return True
        return all(self.agreed[c] if c in self.agreed else self.agrees(c) for c in set(text))

    def agrees(self, c: str) -> bool:
        probe = f"!a{c}a1{c}1!{c} {c}{c}b"
        own = [probe[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(probe)]
        self.agreed[c] = ord(c) < 128 or own == self.pattern.findall(probe)
        return self.agreed[c]

    def counts(self, texts: list[str]) -> list[int]:
        pieces = [self.pattern.findall(t) if self.plain(t) else None for t in texts]
        new = [p for p in set(chain.from_iterable(x for x in pieces if x)) if p not in self.table and p not in self.own]
        if len(self.own) + len(new) > CACHED:
            new = list({*new, *self.own.keys() & set(chain.from_iterable(x for x in pieces if x))})
            self.own.clear()
        lengths = {p: len(e.ids) for p, e in zip(new, self.library.encode_batch_fast(new, add_special_tokens=False), strict=True)}
        self.own.update((p, n) for p, n in lengths.items() if len(p) <= LONGEST)
        table, own = self.table, self.own

        def length(p: str) -> int:
            return table[p] if p in table else own[p] if p in own else lengths[p]

        return [sum(map(length, x)) if x is not None else len(self.library.encode(t, add_special_tokens=False).ids) for t, x in zip(texts, pieces, strict=True)]


def _counts(spec: object, table: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(spec.value, dict(zip(*table.value, strict=True)))
        for ids, texts in _strings(batches):
            yield rows("doc_id bigint, n_bytes bigint, n_tokens bigint", doc_id=ids, n_bytes=[len(t.encode()) for t in texts], n_tokens=counter.counts(texts))

    return run


def token_counts(docs: DataFrame, spec: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row, as the library counts without added special tokens.

    spec: the tokenizer's JSON (the tiers serve byte-level BPE, other kinds are encoded text by text). Null and empty texts have no bytes and no tokens; repeated rows are
    counted each for itself; an empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    pieces = most_frequent(docs) if splits_by_pattern(json.loads(spec)) else []
    lengths = _Counter(spec, {}).counts(pieces) if pieces else []
    broadcast = spark.sparkContext.broadcast
    return docs.mapInArrow(_counts(broadcast(spec), broadcast((pieces, lengths))), "doc_id bigint, n_bytes bigint, n_tokens bigint")
