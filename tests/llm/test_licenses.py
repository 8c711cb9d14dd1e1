"""Licence scan: every rule searched without keywords, containment compared pair by pair, base phrases counted word by word."""

import random
import re

import pytest

from tenurekit.llm import license_scan
from tenurekit.llm.license_rules import KINDS, rules

PIECES = [
    "GNU General Public License, version 3", "gnu general public license", "Apache License, Version 2.0", "licensed under the", "released under", "CC BY-NC 4.0", "cc by", "CC-BY cc by",
    "MIT License", "mit license mit license", "SPDX-License-Identifier: Apache-2.0", "spdx license identifier gpl-3.0-or-later", "Copyright (c) 2021 A. All rights reserved.",
    "Redistribution and use in source and binary forms, with or without modification, are permitted", "BSD 3-Clause", "either version 2 or (at your option) any later version",
    "see the LICENSE file", "gnu lesser general public license 2.1", "Creative Commons Attribution-ShareAlike 4.0 International License", "public", "license", "é", "GNU", "general",
]


def _text(r):
    return " ".join(r.choice(PIECES) if r.random() < 0.6 else "".join(r.choice("abc") for _ in range(3)) for _ in range(r.randrange(30)))


def _plain(text):
    """(words, base places, detections that stay) by definition."""
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    places = []
    for phrase, label in license_scan.BASE.items():
        want = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(want)] == want]
    joined = f" {' '.join(words)} ".encode().decode("latin-1")
    known, hits = rules(), []
    for i, rule in enumerate(known):
        hits += [(m.start(), m.end(), i) for m in re.finditer(rule.pattern, joined)]

    def rank(h):
        return list(KINDS).index(known[h[2]].kind), h[0] - h[1], h[2]

    kept = [h for h in hits if not any(o[0] <= h[0] and h[1] <= o[1] and rank(o) < rank(h) for o in hits)]
    return words, places, sorted(kept)


def test_scan_equals_brute_force(spark, make_docs):
    r = random.Random(5)
    texts = {i: _text(r) for i in range(150)}
    got = {x.doc_id: x for x in license_scan.license_scan(make_docs(*texts.items())).collect()}
    known = rules()
    for i, text in texts.items():
        words, places, kept = _plain(text)
        base = sorted({label for _, label in places})
        assert (got[i].n_words, got[i].n_base) == (len(words), len(places))
        assert got[i].first_word == min((p for p, _ in places), default=None)
        assert got[i].last_word == max((p for p, _ in places), default=None)
        assert got[i].base_labels == ",".join(base)
        assert got[i].rules == [rule for _, _, rule in kept]
        assert got[i].labels == ",".join(sorted({*base, *(known[rule].label for _, _, rule in kept)}))
        assert got[i].score == max((KINDS[known[rule].kind] for _, _, rule in kept), default=0)
        for rule, start, n in zip(got[i].rules, got[i].starts, got[i].lengths, strict=True):
            assert re.fullmatch(known[rule].pattern.removeprefix("(?<= )").removesuffix("(?= )").replace("(?! provided)", ""), " ".join(words[start : start + n]).encode().decode("latin-1"))


def test_rules_are_many_and_each_needs_its_keyword():
    known = rules()
    assert len(known) > 300 and {r.kind for r in known} == set(KINDS)
    for rule in known:
        assert rule.keyword and rule.keyword in re.sub(r"\(\?:|\)\?", "", rule.pattern)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
        ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
        ("Distributed under the BSD 3-Clause License", "bsd-3-clause"),
        ("A recipe with apples and a licence to cook", ""),
        ("apachelicense mit-licenses ccby", ""),
    ],
)
def test_labels(text, labels):
    assert license_scan.worker_scanner().row(text.encode())["labels"] == labels


def test_specific_detection_hides_the_general_one(spark, make_docs):
    found = license_scan.detections(make_docs((1, "x released under the Mozilla Public License 2.0 y"))).collect()
    assert [(d.label, d.kind, d.start, d.n_words, d.confidence) for d in found] == [("mpl-2.0", "notice", 1, 8, 0.9)]


def test_odd_rows(spark, odd_docs):
    got = license_scan.license_scan(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by_id = {x.doc_id: x for x in got}
    for i in (1, 2, 3):
        assert (by_id[i].n_words, by_id[i].n_base, by_id[i].first_word, by_id[i].labels, by_id[i].score) == (0, 0, None, "", 0.0)
    assert by_id[6].n_words == 60_000 and by_id[9].n_words == 5 and by_id[None].n_words == 7
    assert license_scan.license_scan(odd_docs.limit(0)).count() == 0


def test_very_long_text_is_searched_whole():
    row = license_scan.worker_scanner().row(("filler " * 300_000 + "mit license " * 2000 + "end").encode())
    assert (row["n_base"], row["first_word"], row["last_word"]) == (2000, 300_000, 303_998)
