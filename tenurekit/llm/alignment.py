"""Token alignment of two tokenizers over the distinct texts of a corpus.

Rows are shuffled by their full text, so each distinct text is tokenised and aligned once, with the number of its rows
as weight. Byte offsets where tokens of both tokenizers end cut a text into groups; an A token and a B token are linked
where they share a group. Links of the corpus are counted by pairs of ids, and every text's links are then measured by
these counts: the most frequent pairs are looked up in a table of bounded size, the others, none of which is frequent,
are joined.

Workers keep what the slower tokenizer gave for the stretches between blanks.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenurekit.llm.batches import rows
from tenurekit.llm.scratch import staged
from tenurekit.llm.token_counts import PATTERN

#: Pairs of ids whose counts every task gets; a pair outside holds less than 1 / FREQUENT of all (text, pair) rows.
FREQUENT = 1 << 18
#: A text with more than this share of all rows meets them by a broadcast: at most 1 / HOT_SHARE such texts.
HOT_SHARE = 1 / 4096
#: Texts encoded at once, stretches that a worker keeps, their greatest length, and distinct pairs that a task sums before it passes them on.
AT_ONCE, KEPT, LONGEST, PAIRS_HELD = 128, 200_000, 64, 1 << 21
#: Links of one group beyond which they are counted by distinct ids instead of listed.
LISTED = 4096

_ENCODED = "key binary, n_docs bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_pairs bigint, link_a binary, link_b binary, times binary"
_MEASURED = "key binary, n_best bigint, count_sum bigint, pairs array<bigint>, times array<bigint>"
_NO_TOKENS = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "n_pairs": 0, "link_a": b"", "link_b": b"", "times": b""}
_CUT = re.compile(r"(?<=\S)(?= )")


def byte_level_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes are themselves, the others follow from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Both tokenizers in one worker. spec: the JSON of a byte-level BPE (A); model: a SentencePiece model with byte fallback (B)."""

    def __init__(self, spec: str, model: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_str(spec)
        self.first.no_truncation()
        self.first.no_padding()
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_proto=model)
        alphabet = byte_level_bytes()
        vocabulary = self.first.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(map(alphabet.__getitem__, token)) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([len(x) for x in table]) for table in (self.bytes_a, self.bytes_b))
        # each id as text with what may follow it: an id of the same side, the bar between sides, the end of a group
        n_a, n_b = len(self.bytes_a), len(self.bytes_b)
        self.parts = [f"{i}," for i in range(n_a)] + [f"{i}|" for i in range(n_a)] + [f"{i}," for i in range(n_b)] + [f"{i};" for i in range(n_b)]
        self.ranked = self._ranked(json.loads(spec))
        self.agreed: dict[str, bool] = {}
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.kept: dict[str, tuple[int, ...]] = {}

    def _ranked(self, known: dict) -> object | None:
        """A as a faster library has it, by ranks, where its form allows: no normalizer, the usual pattern, merges in the order of their ids."""
        splitter, alphabet = known["pre_tokenizer"] or {}, byte_level_bytes()
        if known["normalizer"] or splitter.get("type") != "ByteLevel" or not splitter.get("use_regex", True) or splitter.get("add_prefix_space"):
            return None
        if any(not x["special"] for x in known["added_tokens"]):
            return None
        vocabulary = known["model"]["vocab"]
        merged = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" "))) for m in known["model"]["merges"]]
        special = {x["content"] for x in known["added_tokens"]}
        if None in merged or merged != sorted(set(merged)) or len(merged) + 256 != len(vocabulary.keys() - special):
            return None
        import tiktoken

        ranks = {bytes(map(alphabet.__getitem__, t)): i for t, i in vocabulary.items() if t not in special}
        return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _same(self, c: str) -> bool:
        """Whether both libraries put a character in the same class."""
        probe = f"!a{c}a1{c}1!{c} {c}{c}b"
        self.agreed[c] = self.first.encode(probe, add_special_tokens=False).ids == self.ranked.encode_ordinary(probe)
        return self.agreed[c]

    def _ids_a(self, text: str) -> list[int]:
        agreed = self.agreed
        if self.ranked and (text.isascii() or all(agreed[c] if c in agreed else self._same(c) for c in set(text))):
            return self.ranked.encode_ordinary(text)
        return self.first.encode(text, add_special_tokens=False).ids

    def _ids_b(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts. No piece runs from a character into a following blank: what lies between such places is encoded once and kept.

        A text that ends in a blank is encoded whole.
        """
        if not self.cuts:
            return self.second.encode(texts, out_type=int, num_threads=1)
        cut = [_CUT.split(" " + t) if not t.endswith(" ") else [" " + t] for t in texts]
        new = list({x for xs in cut for x in xs if x not in self.kept})
        if len(self.kept) + len(new) > KEPT:
            self.kept, new = {}, list({x for xs in cut for x in xs})
        found = dict(zip(new, map(tuple, self.second.encode([x[1:] for x in new], out_type=int, num_threads=1)), strict=True)) if new else {}
        self.kept.update((x, y) for x, y in found.items() if len(x) <= LONGEST)
        kept = self.kept
        return [list(chain.from_iterable([kept[x] if x in kept else found[x] for x in xs])) for xs in cut]

    def texts(self, texts: list[str]) -> list[dict]:
        """The row of each text. Empty ones, and those that one side does not give back byte by byte, have no tokens."""
        out = [dict(_NO_TOKENS) for _ in texts]
        valid, all_a, all_b = [], [], []
        for i, (text, b) in enumerate(zip(texts, self._ids_b(texts), strict=True)):
            if not text:
                continue
            a, whole = self._ids_a(" " + text), b" " + text.encode()
            if b"".join(map(self.bytes_a.__getitem__, a)) == whole and b"".join(map(self.bytes_b.__getitem__, b)) == whole:
                valid.append(i)
                all_a.append(np.array(a, np.int64))
                all_b.append(np.array(b, np.int64))
        if valid:
            for i, row in zip(valid, self._measured(all_a, all_b), strict=True):
                out[i] = row
        return out

    def _measured(self, all_a: list[np.ndarray], all_b: list[np.ndarray]) -> Iterator[dict]:
        """Rows of texts by their ids. The texts lie one behind the other: each ends with a common boundary."""
        a, b = np.concatenate(all_a), np.concatenate(all_b)
        to_a, to_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        ends = np.zeros((2, int(to_a[-1]) + 1), bool)
        ends[0, to_a], ends[1, to_b] = True, True
        a_ends, b_ends = ends[1, to_a], ends[0, to_b]
        group_a, group_b = np.cumsum(a_ends) - a_ends, np.cumsum(b_ends) - b_ends
        n = int(a_ends.sum())
        size_a, size_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        parts = np.empty(len(a) + len(b), np.int64)
        parts[np.arange(len(a)) + first_b[group_a]] = a + len(self.bytes_a) * a_ends
        parts[np.arange(len(b)) + (first_a + size_a)[group_b]] = 2 * len(self.bytes_a) + b + len(self.bytes_b) * b_ends
        at_a, at_b = np.cumsum([0, *map(len, all_a)]), np.cumsum([0, *map(len, all_b)])
        at_group = np.concatenate((group_a[at_a[:-1]], [n]))
        wide = size_a * size_b > LISTED
        listed = np.flatnonzero(~wide[group_a])
        partners = size_b[group_a[listed]]
        place = np.arange(int(partners.sum())) - np.repeat(np.cumsum(partners) - partners - first_b[group_a[listed]], partners)
        pairs = np.repeat(a[listed] << 32, partners) | b[place]
        at_pair = np.searchsorted(place, at_b)
        for i in range(len(all_a)):
            lo, hi = at_group[i], at_group[i + 1]
            own, times = np.unique(pairs[at_pair[i] : at_pair[i + 1]], return_counts=True) if not wide[lo:hi].all() else (pairs[:0], pairs[:0])
            for g in (lo + np.flatnonzero(wide[lo:hi])).tolist():
                more = _counted(a[first_a[g] : first_a[g] + size_a[g]], b[first_b[g] : first_b[g] + size_b[g]])
                own, times = summed([own, more[0]], [times, more[1]])
            text = "".join(map(self.parts.__getitem__, parts[at_a[i] + at_b[i] : at_a[i + 1] + at_b[i + 1]].tolist()))[:-1]
            yield {
                "n_a": len(all_a[i]), "n_b": len(all_b[i]), "n_groups": int(hi - lo), "n_links": int((size_a[lo:hi] * size_b[lo:hi]).sum()),
                "groups_sha256": hashlib.sha256(text.encode()).hexdigest(),
                "n_pairs": len(own), "link_a": _narrow(own >> 32), "link_b": _narrow(own & 0xFFFFFFFF), "times": _narrow(times),
            }


_IN_WORKER: dict[tuple[str, bytes], Aligner] = {}


def worker_aligner(spec: str, model: bytes) -> Aligner:
    """The worker's own, kept from task to task."""
    if (spec, model) not in _IN_WORKER:
        _IN_WORKER.clear()
        _IN_WORKER[spec, model] = Aligner(spec, model)
    return _IN_WORKER[spec, model]


def _counted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, times) of a group with many links."""
    (ids_a, times_a), (ids_b, times_b) = (np.unique(x, return_counts=True) for x in (a, b))
    return ((ids_a[:, None] << 32) | ids_b).ravel(), (times_a[:, None] * times_b).ravel()


def _narrow(numbers: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold all of them."""
    return numbers.astype(next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(numbers) or numbers.max() < 1 << 8 * int(k[2:]))).tobytes()


def _widened(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, f"<u{len(packed) // n}").astype(np.int64) if n else np.empty(0, np.int64)


def summed(pairs: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs and the sums of their values."""
    distinct, at = np.unique(np.concatenate(pairs), return_inverse=True)
    out = np.zeros(len(distinct), np.int64)
    np.add.at(out, at, np.concatenate(values))
    return distinct, out


def _encode(given: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = worker_aligner(*given.value)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                keys, n_docs, texts = (c.slice(at, AT_ONCE) for c in batch.columns[:3])
                out = aligner.texts([t.decode(errors="replace") for t in texts.cast(pa.large_binary()).to_pylist()])
                yield rows(_ENCODED, key=keys.to_pylist(), n_docs=n_docs.to_pylist(), **{name: [o[name] for o in out] for name in out[0]})

    return run


def _texts_links(batch: pa.RecordBatch) -> Iterator[tuple[bytes, int, np.ndarray, np.ndarray]]:
    """(key, n_docs, distinct pairs, their times) of each encoded text."""
    names = ("key", "n_docs", "n_pairs", "link_a", "link_b", "times")
    for key, n_docs, n, a, b, times in zip(*(batch.column(batch.schema.get_field_index(name)).to_pylist() for name in names), strict=True):
        yield key, n_docs, _widened(a, n) << 32 | _widened(b, n), _widened(times, n)


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n): documents of this task that hold a pair. Sums are passed on whenever many pairs are held."""

    def out(pairs: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(pairs), 1 << 16):
            yield rows("pair bigint, n bigint", pair=pairs[at : at + (1 << 16)], n=counts[at : at + (1 << 16)])

    pairs, counts, size = [], [], 0
    for batch in batches:
        for _, n_docs, own, _ in _texts_links(batch):
            pairs.append(own)
            counts.append(np.full(len(own), n_docs))
            size += len(own)
            if size > 2 * PAIRS_HELD:
                held, sums = summed(pairs, counts)
                if len(held) > PAIRS_HELD:
                    yield from out(held, sums)
                    held, sums = held[:0], sums[:0]
                pairs, counts, size = [held], [sums], len(held)
    if pairs:
        yield from out(*summed(pairs, counts))


def _measure(table: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = (np.frombuffer(x, kind) for x, kind in zip(table.value, (np.int64, np.int64, np.bool_), strict=True))
        for batch in batches:
            out = {"key": [], "n_best": [], "count_sum": [], "pairs": [], "times": []}
            for key, _, pairs, times in _texts_links(batch):
                place = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
                hit = known[place] == pairs if len(known) else np.zeros(len(pairs), bool)
                place, own = place[hit], times[hit]
                for name, value in (("key", key), ("n_best", int(own[best[place]].sum())), ("count_sum", int((counts[place] * own).sum())), ("pairs", pairs[~hit]), ("times", times[~hit])):
                    out[name].append(value)
            yield rows(_MEASURED, **out)

    return run


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def encoded_texts(docs: DataFrame, spec: str, model: bytes, text: str = "text") -> DataFrame:
    """One row for each distinct text: key (its SHA-256), n_docs, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct links (packed pairs of ids, and how often each occurs)."""
    spark = docs.sparkSession
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    distinct = docs.select(own.alias("text")).groupBy("text").agg(F.count("*").alias("n_docs"))
    encode = _encode(spark.sparkContext.broadcast((spec, model)))
    return staged(distinct.select(text_key(F.col("text")).alias("key"), "n_docs", "text").mapInArrow(encode, _ENCODED), "aligned", "zstd")


def pair_counts(encoded: DataFrame) -> DataFrame:
    """(a, b, n, is_best): documents in which the ids are linked, and whether no other partner of a has more."""
    counts = staged(encoded.mapInArrow(_count_pairs, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")), "aligned-pairs")
    counts = counts.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "n")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("is_best"))


def alignment(docs: DataFrame, spec: str, model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    n_best: links whose pair of ids has its A id's highest count; count_sum: the counts of all links. Null and empty texts,
    and texts that one tokenizer does not give back byte by byte, have no tokens: zeros and an empty digest. Repeated rows
    count each for itself; ties are all best; an empty table gives no rows; other columns are ignored. One text's tokens
    and distinct links are held by one task, whatever its length.
    """
    spark = docs.sparkSession
    encoded = encoded_texts(docs, spec, model, text)
    pairs = staged(pair_counts(encoded).select(F.shiftleft("a", 32).bitwiseOR(F.col("b")).alias("pair"), "n", "is_best"), "aligned-counts")
    top = pairs.orderBy(F.desc("n"), "pair").limit(FREQUENT).toArrow().sort_by("pair")  # FREQUENT rows at most
    table = tuple(np.ascontiguousarray(top[name].to_numpy()).tobytes() for name in ("pair", "n", "is_best"))
    measured = staged(encoded.mapInArrow(_measure(spark.sparkContext.broadcast(table)), _MEASURED), "aligned-measures")
    missed = measured.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("m")).select("key", F.col("m.pairs").alias("pair"), F.col("m.times").alias("times"))
    rest = missed.join(pairs, "pair").groupBy("key").agg(F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    n_best = (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best")
    count_sum = (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum")
    texts = encoded.drop("n_pairs", "link_a", "link_b", "times").join(measured.select("key", "n_best", "count_sum"), "key").join(rest, "key", "left")
    texts = staged(texts.select("key", "n_docs", "n_a", "n_b", "n_groups", "n_links", n_best, count_sum, "groups_sha256"), "aligned-texts")
    return _per_document(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_key(F.col(text)).alias("key")), texts)


def _per_document(keyed: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of keyed with their text's measures. Texts with a large share of the rows are broadcast, so no key of the join is frequent."""
    least = F.greatest(F.lit(1), F.col("n_rows") * HOT_SHARE)
    all_rows = texts.agg(F.sum("n_docs").alias("n_rows"))
    limit = all_rows.select(least).first()[0]
    limit = 1 if limit is None else limit
    measures = [c for c in texts.columns if c not in ("key", "n_docs")]
    hot = F.broadcast(texts.where(F.col("n_docs") > limit).select(F.col("key"), F.struct(*measures).alias("hot")))  # 1 / HOT_SHARE rows at most
    marked = keyed.join(hot, "key", "left")
    found = marked.where("hot is not null").select("doc_id", "hot.*")
    cold = marked.where("hot is null").drop("hot").join(texts.where(F.col("n_docs") <= limit), "key")
    return found.unionByName(cold.select("doc_id", *measures))

