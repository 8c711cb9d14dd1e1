"""Jaccard join, chaining and winnowing against brute force, with skew, ties and odd rows."""

import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from tenurekit.llm import chaining, jaccard_join, winnowing
from tenurekit.llm.chaining import repeated_passages
from tenurekit.llm.components import components
from tenurekit.llm.jaccard_join import jaccard_components, one_of_each
from tenurekit.llm.scratch import staged
from tenurekit.llm.winnowing import benchmark_spans, clean_documents, contamination
from tenurekit.llm.words import word_hashes

from .llm_words import words


def _text(r, n, vocabulary=4000):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def _edited(r, text, share):
    return " ".join(w if r.random() > share else f"e{r.randrange(10**6)}" for w in text.split())


def _shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def _components(texts):
    sets = {i: _shingles(t) for i, t in texts.items()}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.fixture(scope="module")
def similar():
    """Copies, near copies at all distances, a passage that a third of the texts share, and short texts."""
    r = random.Random(4)
    passage, texts = _text(r, 60), []
    for _ in range(12):
        base = _text(r, r.randrange(5, 300))
        texts += [base] * r.randrange(1, 4) + [_edited(r, base, s) for s in (0.005, 0.01, 0.02, 0.03, 0.05)]
    hot = _text(r, 150)
    texts += [_edited(r, hot, 0.01) for _ in range(60)] + [hot] * 30
    texts += [f"{_text(r, 80)} {passage} {_text(r, 80)}" for _ in range(40)]
    texts += [" ".join(w) for w in ("a", "a b", "a b c d", "a b c d e", "a b c d e f")] * 2 + ["", None, "A B c"]
    r.shuffle(texts)
    return dict(enumerate(texts, 1))


@pytest.mark.parametrize("tile", [512, 8])
def test_components_equal_brute_force(make_docs, similar, monkeypatch, tile):
    monkeypatch.setattr(jaccard_join, "TILE_DOCS", tile)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(make_docs(*similar.items())).collect()}
    assert got == _components(similar)


@pytest.mark.parametrize(("common", "block"), [(2, 256), (24, 1)])
def test_order_of_tokens_and_large_blocks_do_not_change_components(make_docs, similar, monkeypatch, common, block):
    monkeypatch.setattr(jaccard_join, "COMMON", common)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(make_docs(*similar.items())).collect()}
    assert got == _components(similar)


def test_bound_never_loses_a_link():
    r = np.random.default_rng(1)
    for n in (1, 5, 40, 300, 3000, 9000):
        items = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        for drop in (0.0, 0.1, 0.19):
            other = items[r.random(len(items)) >= drop]
            if len(other) and len(other) >= 0.8 * len(items):
                assert jaccard_join._may_link(*(jaccard_join._counts(jaccard_join._point(x)) for x in (items, other)))


def test_odd_rows_in_the_join(odd_docs):
    got = Counter((r.doc_id, r.component_id, r.n_copies) for r in jaccard_components(odd_docs).collect())
    assert got == Counter({(1, 1, 1): 1, (2, 2, 1): 1, (3, 3, 1): 1, (4, 4, 3): 2, (5, 4, 3): 1, (None, None, 1): 1, (6, 6, 2): 1, (7, 6, 2): 1, (8, 8, 1): 1, (9, 9, 1): 1})
    kept = one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 8, 9]


def test_empty_tables(odd_docs, spark):
    none = odd_docs.limit(0)
    assert jaccard_components(none).count() == repeated_passages(none).count() == contamination(none, none, item_id="doc_id").count() == 0
    assert contamination(odd_docs, none, item_id="doc_id").where("contaminated").count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 50)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 1 for i in range(1, 50)}


@pytest.mark.parametrize(
    "edits", [0.0, pytest.param(0.03, marks=pytest.mark.xfail(reason="of 15 copies edited apart one is missed: its matches lie with several partners", strict=False))]
)
def test_passages_are_found_and_clean_texts_left_alone(make_docs, edits):
    r = random.Random(9)
    passage = _text(r, 70)
    texts = {i: _text(r, r.randrange(20, 400)) for i in range(1, 41)}
    for i in range(1, 16):
        texts[i] = f"{_text(r, 40)} {_edited(r, passage, edits)} {_text(r, 40)}"
    texts[41] = texts[42] = texts[20] + " " + _text(r, 60)
    rows = repeated_passages(make_docs(*texts.items())).collect()
    assert {x.doc_id for x in rows} >= set(range(1, 16)) | {41, 42}
    long_enough = {20} if len(texts[20].split()) >= 60 else set()
    assert {x.doc_id for x in rows} <= set(range(1, 16)) | {41, 42, 20} and {x.doc_id for x in rows} >= long_enough
    for x in rows:
        a, b = words(texts[x.doc_id])[x.start : x.start + x.n_words], words(texts[x.other_id])[x.other_start : x.other_start + x.other_words]
        assert len(a) == x.n_words >= 50 and len(b) == x.other_words >= 50 and len(set(a) & set(b)) >= 0.6 * len(set(a))


def test_passages_whose_parts_stand_in_other_texts_too(make_docs):
    r = random.Random(12)
    texts = {}
    for case in range(20):
        passage = _text(r, 64).split()
        parts = [passage, passage, *[passage[:36]] * 4, *[passage[28:]] * 4]
        for k, part in enumerate(parts):
            texts[100 * case + k + 1] = f"{_text(r, 40)} {' '.join(part)} {_text(r, 40)}"
    found = {(x.doc_id, x.other_id) for x in repeated_passages(make_docs(*texts.items())).collect()}
    assert found == {(100 * c + a, 100 * c + b) for c in range(20) for a, b in ((1, 2), (2, 1))}


@pytest.mark.parametrize("n", [40, 80, 150])
def test_passages_whose_parts_are_common(make_docs, n):
    """Both halves of a passage of 64 words stand in n other texts each: the two texts with all of it still meet."""
    r = random.Random(n)
    texts = {}
    for case in range(3):
        passage = _text(r, 64).split()
        parts = [passage, passage, *[passage[:34]] * n, *[passage[30:]] * n]
        r.shuffle(parts)
        texts |= {1000 * case + k: f"{_text(r, 40)} {' '.join(part)} {_text(r, 40)}" for k, part in enumerate(parts)}
    whole = {i: [k for k, t in texts.items() if k // 1000 == i and len(t.split()) == 144] for i in range(3)}
    found = {(x.doc_id, x.other_id) for x in repeated_passages(make_docs(*texts.items())).collect()}
    assert found == {pair for a, b in whole.values() for pair in ((a, b), (b, a))}


@pytest.mark.parametrize(("crowd", "common"), [(64, 64), (2, 2)])
def test_equal_runs_join_texts_in_any_crowd(make_docs, monkeypatch, crowd, common):
    """Texts that hold ever different parts of a few passages: two that share 50 words in a row reach each other, others do not."""
    monkeypatch.setattr(chaining, "CROWD", crowd)
    monkeypatch.setattr(chaining, "COMMON", common)
    r = random.Random(crowd)
    held = {}
    for case in range(6):
        passage = _text(r, 300, 10**6).split()
        for k in range(60):
            lo, n = r.randrange(240), r.randrange(32, 60)
            held[100 * case + k] = (case, lo, min(300, lo + n), f"{_text(r, 30, 10**6)} {' '.join(passage[lo : lo + n])} {_text(r, 30, 10**6)}")
    rows = repeated_passages(make_docs(*((i, t) for i, (*_, t) in held.items()))).collect()
    label = {i: i for i in held}
    for x in rows:
        a, b = label[x.doc_id], label[x.other_id]
        label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    want = {i: i for i in held}
    for i, (case, lo, hi, _) in held.items():
        for j, (other, low, high, _) in held.items():
            if i < j and case == other and min(hi, high) - max(lo, low) >= 50:
                a, b = want[i], want[j]
                want = {k: min(a, b) if v in (a, b) else v for k, v in want.items()}
    assert label == want
    assert {x.doc_id: x.class_id for x in rows} == {i: label[i] for i in {x.doc_id for x in rows}}


def test_edited_passages_of_a_crowd_are_found(make_docs, monkeypatch):
    """48 words stand in 60 texts; each two of them also share the 20 words that follow, of which every fifth differs."""
    monkeypatch.setattr(chaining, "CROWD", 4)
    monkeypatch.setattr(chaining, "LEAST_TILE", 50, raising=False)
    r = random.Random(21)
    common, texts = _text(r, 48, 10**6), {}
    for case in range(30):
        tail = _text(r, 20, 10**6).split()
        for side in range(2):
            own = [w if k % 5 else f"d{side}x{case}x{k}" for k, w in enumerate(tail)]
            texts[2 * case + side] = f"{_text(r, 30, 10**6)} {common} {' '.join(own)} {_text(r, 30, 10**6)}"
    rows = repeated_passages(make_docs(*texts.items())).collect()
    assert {(x.doc_id, x.other_id) for x in rows} == {(i, i ^ 1) for i in texts}
    assert len(rows) == len(texts) and all(x.n_words >= 64 for x in rows)


@pytest.mark.parametrize("seed", range(2))
def test_crowds_give_the_classes_of_all_pairs(make_docs, monkeypatch, seed):
    """Edited parts of a few passages: classes do not depend on how many texts make a crowd."""
    r = random.Random(seed)
    texts = {}
    for case in range(3):
        passage = _text(r, 120, 10**6)
        for k in range(40):
            part = _edited(r, passage, 0.06).split()
            lo, n = r.randrange(70), r.randrange(40, 60)
            texts[100 * case + k] = f"{_text(r, 30, 10**6)} {' '.join(part[lo : lo + n])} {_text(r, 30, 10**6)}"
    found = {}
    for crowd in (10**6, 4):
        monkeypatch.setattr(chaining, "CROWD", crowd)
        found[crowd] = {x.doc_id: x.class_id for x in repeated_passages(make_docs(*texts.items())).collect()}
    assert found[4] == found[10**6] and len(found[4]) > 20


def test_words_that_differ_between_two_passages_cost_neither(make_docs):
    r = random.Random(5)
    first, second = _text(r, 200), _text(r, 200)
    rows = repeated_passages(make_docs(*((i, f"{first} {_text(r, 300)} {second}") for i in (1, 2)))).collect()
    assert {(x.doc_id, x.other_id) for x in rows} == {(1, 2), (2, 1)}
    assert {(x.start // 100, x.n_words // 100) for x in rows} == {(0, 2), (5, 2)}


def test_no_passage_lies_within_another_of_the_same_texts(make_docs):
    """Two short equal parts, and between them words of which every fifth differs: chains of either part reach over the other."""
    r = random.Random(11)
    texts = {}
    for case in range(60):
        parts = [_text(r, n, 10**6).split() for n in (r.randrange(16, 26), r.randrange(36, 48), r.randrange(15, 20))]
        for side in range(2):
            between = [w if k % 5 else f"d{side}x{case}x{k}" for k, w in enumerate(parts[1])]
            texts[2 * case + side] = " ".join([_text(r, 30, 10**6), *parts[0], *between, *parts[2], _text(r, 70, 10**6)])
    rows = repeated_passages(make_docs(*texts.items())).collect()
    assert {(x.doc_id, x.other_id) for x in rows} == {(i, i ^ 1) for i in texts}
    for x in rows:
        for y in rows:
            if (x.doc_id, x.other_id) == (y.doc_id, y.other_id) and x != y:
                inside = y.start <= x.start and y.start + y.n_words >= x.start + x.n_words
                assert not (inside and y.other_start <= x.other_start and y.other_start + y.other_words >= x.other_start + x.other_words)


def test_stored_tables_leave_no_shuffle_files(spark):
    def files():
        found = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in found.split("\n") if "shuffle_" in f}

    before, setting = files(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    stored = staged(spark.range(10_000).selectExpr("id", "id % 100 as k").repartition("k").groupBy("k").count(), "cleanup")
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left
    assert stored.count() == 100
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting


def test_chains_without_a_choice_are_those_of_the_tree():
    r = np.random.default_rng(8)
    for _ in range(300):
        n = r.integers(1, 12)
        x, y = (np.sort(r.choice(307, n, replace=False)) for _ in range(2))
        starts, choice = chaining._runs(np.zeros(n, int), x, y)
        if not len(choice):
            best = max(chaining.chains(x, y), key=len)
            assert best in [list(range(lo, hi)) for lo, hi in zip(starts, [*starts[1:], n])]


def test_recall_of_edited_passages(make_docs):
    """Every text has one of 60 passages of 70 words, edited at 5 %; texts that hold one are to be found with a partner."""
    r = random.Random(77)
    passages = [_text(r, 70) for _ in range(60)]
    texts = {i: f"{_text(r, 50)} {_edited(r, passages[i % 60], 0.05)} {_text(r, 50)}" for i in range(300)}
    rows = repeated_passages(make_docs(*texts.items())).collect()
    assert all(x.doc_id % 60 == x.other_id % 60 for x in rows)
    assert len({x.doc_id for x in rows}) >= 0.95 * len(texts)


def test_copies_edited_apart_are_found(make_docs):
    r = random.Random(9)
    passage = _text(r, 70)
    texts = {i: _text(r, r.randrange(20, 400)) for i in range(1, 41)}
    for i in range(1, 16):
        texts[i] = f"{_text(r, 40)} {_edited(r, passage, 0.03)} {_text(r, 40)}"
    rows = repeated_passages(make_docs(*texts.items())).collect()
    assert {x.doc_id for x in rows} == set(range(1, 16))
    assert len({(x.doc_id, x.start, x.other_id, x.other_start) for x in rows}) == len(rows)


def test_one_seed_and_close_edits_do_not_hide_a_passage(make_docs):
    r = random.Random(31)
    texts = {}
    for case in range(30):
        passage = _text(r, 60).split()
        other = [f"x{case}e{k}" if k in (10, 12, 22, 34, 46, 47) else w for k, w in enumerate(passage)]
        texts |= {2 * case + 1 + k: f"{_text(r, 40, 10**6)} {' '.join(own)} {_text(r, 40, 10**6)}" for k, own in enumerate((passage, other))}
    shared = set()
    for i in range(1, 61, 2):
        a, b = (set(chaining.seeds(word_hashes([texts[k].encode()])[0])[0].tolist()) for k in (i, i + 1))
        shared |= {i, i + 1} if a & b else set()
    assert {x.doc_id for x in repeated_passages(make_docs(*texts.items())).collect()} == shared


def test_texts_that_repeat_a_line_stay_linear(make_docs):
    line = "again and again the same words come in this line "
    rows = repeated_passages(make_docs((1, line * 400), (2, line * 390), (3, "x " * 3000), (4, "x " * 2900))).collect()
    assert {(x.doc_id, x.other_id) for x in rows} >= {(1, 2), (2, 1), (3, 4), (4, 3)}


def test_odd_rows_in_chaining(odd_docs):
    got = {(x.doc_id, x.other_id, x.n_words) for x in repeated_passages(odd_docs).collect()}
    assert got == {(6, 7, 60_000), (7, 6, 60_000)}


def test_chains_against_all_pairs():
    r = random.Random(2)
    for _ in range(40):
        n = r.randrange(1, 40)
        x, y = np.array([r.randrange(60) for _ in range(n)]), np.array([r.randrange(60) for _ in range(n)])
        best = [0.0] * n
        for i in sorted(range(n), key=lambda i: x[i]):
            gains = [best[j] - chaining.GAP * float(x[i] - x[j] + y[i] - y[j]) for j in range(n) if x[j] < x[i] and y[j] < y[i]]
            best[i] = chaining.K + max([0.0, *gains])
        chain = chaining.chains(x, y)[0]
        own = sum(chaining.K - chaining.GAP * float(x[b] - x[a] + y[b] - y[a]) for a, b in zip(chain, chain[1:])) + chaining.K
        assert own == pytest.approx(max(best))
        assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(chain, chain[1:]))


def _brute_hits(doc, items):
    import re

    find = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    w, hit, met = find(doc), set(), set()
    for item, text in items:
        own = find(text)
        n = min(10, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for at in range(len(w) - n + 1):
            if n and tuple(w[at : at + n]) in windows:
                hit |= set(range(at, at + n))
                met.add(item)
    return len(w), len(hit), sorted(map(str, met))


def test_winnowing_equals_brute_force(make_docs, spark):
    r = random.Random(6)
    items = [(i, _text(r, r.choice((0, 1, 3, 9, 10, 11, 40)), 300)) for i in range(30)] + [(30, None), (0, "w1, w2; W3"), (31, "漢字 é-ß")]
    docs = []
    for i in range(60):
        parts = [_text(r, r.randrange(0, 60), 3000)]
        for _ in range(r.randrange(3)):
            own = (r.choice(items)[1] or "").split()
            lo = r.randrange(len(own) + 1)
            parts += [" ".join(own[lo : lo + r.choice((5, 10, 15, 40))]).upper(), _text(r, 7, 3000)]
        docs.append((i, " -- ".join(parts)))
    docs += [(60, None), (61, ""), (62, "漢字 É-ß é ß"), (3, "w1 w2 w3")]
    table = make_docs(*docs)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((x.doc_id, x.n_words, x.n_hit, tuple(x.item_ids)) for x in contamination(table, bench).collect())
    want = Counter((i, n, h, tuple(m)) for i, t in docs for n, h, m in [_brute_hits(t, items)])
    assert got == want
    clean = clean_documents(table, bench)
    assert clean.columns == table.columns
    assert sorted(x.doc_id for x in clean.collect()) == sorted(i for i, t in docs if not _brute_hits(t, items)[1])


def test_winnowing_keeps_a_fingerprint_of_every_window():
    h = np.random.default_rng(3).integers(0, 2**63, 200, dtype=np.uint64)
    other = np.concatenate([h[50:60], h[:5]])
    assert winnowing.fingerprints(h)[50] == winnowing.fingerprints(other)[0]


def test_spans_of_repeated_rows(make_docs, spark):
    bench = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "x y")], "item_id long, text string")
    documents, spans = benchmark_spans(make_docs((1, "q a b c"), (1, "q a b c"), (2, "x y")), bench)
    assert documents.count() == 3
    by_row = defaultdict(list)
    for s in spans.collect():
        by_row[s.row].append((s.start, s.length, s.item_id))
    assert sorted(map(tuple, by_row.values()), key=str) == [((0, 2, None),), ((1, 3, 1),), ((1, 3, 1),)]
