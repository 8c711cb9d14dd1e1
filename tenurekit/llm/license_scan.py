"""Licence detections by ordered signature rules.

Each text is reduced to its words. One Aho-Corasick pass looks for the rules' keywords; only rules whose keyword stands
in the text are searched. A detection is dropped if it lies within one of a rule of higher priority, within a longer one
of its own priority, or on the words of an earlier rule of its own priority. All other detections stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenurekit.llm.batches import ids_and_texts, rows
from tenurekit.llm.license_rules import KINDS, Rule, rules

#: Phrases and the labels they always give (fixed values).
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_WORD_BYTES = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_AS_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES else 0x20 for b in range(256))
_SCANNED = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
    "rules array<int>, starts array<bigint>, lengths array<bigint>"
)


def normal(text: bytes | None) -> tuple[str, int]:
    """(the words with a blank before and after each, their number). Bytes from 0x80 on stay single characters."""
    words = (text or b"").translate(_AS_WORDS).split()
    return f" {b' '.join(words).decode('latin-1')} ", len(words)


class Scanner:
    """The rules in one worker."""

    def __init__(self, known: Iterable[Rule]) -> None:
        import ahocorasick

        self.rules = list(known)
        self.level = [list(KINDS).index(r.kind) for r in self.rules]
        self.patterns: list[re.Pattern | None] = [None] * len(self.rules)
        gates: dict[str, list[int]] = {}
        for i, rule in enumerate(self.rules):
            gates.setdefault(f" {rule.keyword} ", []).append(i)
        self.gates = ahocorasick.Automaton()
        for keyword, gated in [*gates.items(), *((f" {phrase} ", ()) for phrase in BASE if f" {phrase} " not in gates)]:
            self.gates.add_word(keyword, (keyword, gated))
        self.gates.make_automaton()

    def found(self, text: str) -> tuple[list[tuple[int, str]], list[tuple[int, int, int]]]:
        """Base places (offset, label), and (start, end, rule) of all detections, of a normal text."""
        places, open_rules = [], {}
        for end, (keyword, gated) in self.gates.iter(text):
            label = BASE.get(keyword[1:-1])
            if label:
                places.append((end - len(keyword) + 2, label))
            open_rules[keyword] = gated
        hits = []
        for i in sorted(i for gated in open_rules.values() for i in gated):
            if self.patterns[i] is None:
                self.patterns[i] = re.compile(self.rules[i].pattern)
            hits.extend((m.start(), m.end(), i) for m in self.patterns[i].finditer(text))
        return places, hits

    def kept(self, hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Detections that do not lie within one that comes before them, in order of place."""
        out: list[tuple[int, int, int]] = []
        above: list[tuple[int, int]] = []  # (start, greatest end so far) of the levels above
        ranked = sorted(hits, key=lambda h: (self.level[h[2]], h[0], -h[1], h[2]))
        for _, same in groupby(ranked, key=lambda h: self.level[h[2]]):
            level, at, reach, furthest = list(same), 0, -1, -1
            for start, end, i in level:
                while at < len(above) and above[at][0] <= start:
                    furthest = above[at][1]
                    at += 1
                if furthest < end and reach < end:
                    out.append((start, end, i))
                reach = max(reach, end)
            furthest, merged = -1, []
            for start, end in sorted([*above, *((s, e) for s, e, _ in level)]):
                furthest = max(furthest, end)
                merged.append((start, furthest))
            above = merged
        return sorted(out)

    def row(self, text: bytes | None) -> dict:
        words, n = normal(text)
        places, hits = self.found(words)
        hits = self.kept(hits)
        number = _word_numbers(words, [p for p, _ in places] + [x for s, e, _ in hits for x in (s, e)])
        base = sorted({label for _, label in places})
        at = sorted(number[p] for p, _ in places)
        labels = sorted({*base, *(self.rules[i].label for _, _, i in hits)})
        return {
            "n_words": n, "n_base": len(at), "first_word": at[0] if at else None, "last_word": at[-1] if at else None, "base_labels": ",".join(base), "labels": ",".join(labels),
            "score": max((KINDS[self.rules[i].kind] for _, _, i in hits), default=0.0),
            "rules": [i for _, _, i in hits], "starts": [number[s] for s, _, _ in hits], "lengths": [number[e] - number[s] + 1 for s, e, _ in hits],
        }


def _word_numbers(words: str, offsets: Iterable[int]) -> dict[int, int]:
    """The word, counted from 0, that starts at, holds or ends at each offset."""
    out, last, count = {}, 0, -1
    for at in sorted(set(offsets)):
        count += words.count(" ", last, at)
        out[at], last = count, at
    return out


_IN_WORKER: list[Scanner] = []


def worker_scanner() -> Scanner:
    if not _IN_WORKER:
        _IN_WORKER.append(Scanner(rules()))
    return _IN_WORKER[0]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = worker_scanner()
    for ids, texts in ids_and_texts(batches):
        found = [scanner.row(t) for t in texts]
        yield rows(_SCANNED, doc_id=ids, **{name: [f[name] for f in found] for name in found[0]})


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and the
    detections that stay (rules: numbers in ``license_rules.rules()``; starts and lengths in words).

    Base: places of the fixed phrases. labels: those of the base and of all detections. score: the greatest confidence of a
    detection, 0 without any. Null and empty texts have no words and no labels; texts of any length are searched whole;
    repeated rows are judged alike; an empty table gives no rows; extra columns do not matter.
    """
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(_scan, _SCANNED)


def detections(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, label, kind, start, n_words, confidence) of each detection."""
    known = rules()
    names = F.array(*(F.struct(F.lit(r.label).alias("label"), F.lit(r.kind).alias("kind"), F.lit(KINDS[r.kind]).alias("confidence")) for r in known))
    each = F.explode(F.arrays_zip("rules", "starts", "lengths")).alias("d")
    found = license_scan(docs, doc_id, text).select("doc_id", each).withColumn("rule", F.get(names, F.col("d.rules")))
    return found.select("doc_id", "rule.label", "rule.kind", F.col("d.starts").alias("start"), F.col("d.lengths").alias("n_words"), "rule.confidence")
