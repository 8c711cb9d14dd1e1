"""Language model, token counts, URL filter, page texts, quality rules, mixing and sharding."""

import itertools
import json
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from .llm_words import held_out, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tenurekit.llm import apportion, hilbert, hmm, queries, token_counts
from tenurekit.llm.dom import WRAPPER, Page, decode, features, text_of
from tenurekit.llm.dom_boosting import main_texts
from tenurekit.llm.line_frequency import cleaned_documents, judged, kept_documents, without_frequent_lines
from tenurekit.llm.url_terms import judged_urls
from tenurekit.llm.words import LETTERS_DIGITS, NOT_BLANK, grams, word_hashes

FOLDER = "/root/testdata/sf0.001"


def _check_base(rows, texts):
    """texts: (doc_id, text) of all rows; rows by doc_id."""
    counts = Counter()
    for i, t in texts:
        if not held_out(i):
            counts.update([*words(t), "end"])
    n, v = sum(counts.values()), len(counts)
    for i, t in texts:
        own = [*words(t), "end"]
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held_out(i), len(own), n)
        assert r.n_known == sum(counts[w] > 0 for w in own)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel=1e-9)


@pytest.mark.parametrize("table", [hmm.TABLE, 300])
def test_unigram_scores_and_held_out_gain(spark, monkeypatch, table):
    monkeypatch.setattr(hmm, "TABLE", table)  # with a small table most words find their counts by the join
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("tail", F.lit(1))
    rows = {r.doc_id: r for r in hmm.scored(docs).collect()}
    _check_base(rows, [(r.doc_id, r.text) for r in docs.collect()])
    unseen = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_forward_recursion_equals_all_paths():
    r = np.random.default_rng(8)
    k = hmm.STATES
    emits = r.random((5, k))
    moves, start = r.random((k, k)), r.random(k)
    model = hmm.Model(start / start.sum(), start / start.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(0))
    sequences = [np.array(s, np.uint16) for s in ([0], [1, 4, 2], [3, 3], [2, 0, 1])]
    for seq, got in zip(sequences, hmm.log_likelihoods(model, sequences), strict=True):
        total = sum(
            model.start[p[0]] * model.emits[seq[0], p[0]] * math.prod(model.moves[a, b] * model.emits[s, b] for a, b, s in zip(p, p[1:], seq[1:]))
            for p in itertools.product(range(k), repeat=len(seq))
        )
        assert got == pytest.approx(math.log10(total))


def test_training_raises_likelihood_and_sums_are_whole(monkeypatch):
    monkeypatch.setattr(hmm, "CLASSES", 6)
    r = np.random.default_rng(1)
    sequences = [r.integers(0, 6, r.integers(1, 30)).astype(np.uint16) for _ in range(50)]
    unigram = np.full(6, 1 / 6)
    model, first, before = hmm.Model.random(unigram), np.ones(50, bool), -math.inf
    for _ in range(5):
        sums, of_words = hmm.expected_counts(model, sequences, first, [q.astype(np.int32) + 6 * (q % 2) for q in sequences], 12)
        assert np.allclose(of_words[:6] + of_words[6:], sums[:6]) and not of_words[1:6:2].any()
        assert sums[:6].sum() == pytest.approx(sum(map(len, sequences)))
        assert sums[-1].sum() == pytest.approx(50)
        now = hmm.log_likelihoods(model, sequences).sum()
        assert now >= before - 0.5  # smoothing may cost a little
        before, model = now, model.refitted(sums, unigram)


def test_scores_equal_a_plain_model(spark, monkeypatch):
    """Every word's emissions from the trained sums, and the forward recursion, in plain Python."""
    monkeypatch.setattr(hmm, "TABLE", 300)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 10 == 0)
    seen, vocabulary = hmm.learn_vocabulary(docs)
    shared = spark.sparkContext.broadcast(vocabulary)
    coded = hmm.staged(docs.mapInArrow(hmm._code(shared), hmm._CODED), "test-coded")
    model, states, expected = hmm.train(coded, vocabulary, shared)
    seen = {r.token: r for r in seen.where("shape >= 0").collect()}
    kept = {r.token: np.array(r[-hmm.STATES :]) for r in states.collect()}
    own = {int(w): c for w, c in zip(vocabulary.words.view(np.int64), vocabulary.own) if c}
    rare = {t: r for t, r in seen.items() if t not in own}
    assert kept.keys() == {t for t, r in rare.items() if r.found >= hmm.KEEP} and len(kept) > 100
    assert all(sums.sum() == pytest.approx(rare[t].found, rel=0.1) for t, sums in kept.items())

    def weight(token, shape):
        of_class = expected[1 + hmm.OWN + shape] + 0.1
        of_class = of_class / of_class.sum()
        found = rare[token].found if token in rare else 0
        if token not in kept:
            return (found + 0.1) * of_class
        return (found + 0.1) * (kept[token] + hmm.PRIOR * of_class) / (found + hmm.PRIOR)

    mass = {s: weight(None, s) for s in range(hmm.SHAPES)}
    for t, r in rare.items():
        mass[r.shape] = mass[r.shape] + weight(t, r.shape)
    rows = {r.doc_id: r.score for r in hmm.scored(docs).collect()}
    for r in docs.collect()[::7]:
        hashes, _, shapes = hmm.word_shapes([(r.text or "").encode()])
        alpha, total = model.start, 0.0
        for i, (token, shape) in enumerate([*zip(hashes.view(np.int64).tolist(), shapes.tolist()), (None, None)]):
            if i:
                alpha = alpha @ model.moves
            emits = model.emits[0] if shape is None else model.emits[own[token]] if token in own else model.emits[1 + hmm.OWN + shape] * weight(token, shape) / mass[shape]
            alpha = alpha * emits
            total += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
        assert rows[r.doc_id] == pytest.approx(total, rel=1e-5)


def test_every_pass_takes_all_texts_and_every_word_has_states(spark, make_docs, monkeypatch):
    """Long texts are part of all passes, and rare words have state-wise counts, too."""
    monkeypatch.setattr(hmm, "TABLE", 100)
    r = random.Random(3)
    texts = [" ".join("w" + "".join(chr(97 + int(c)) for c in str(int(3000 * r.random() ** 3))) for _ in range(2_300)) for _ in range(14)]
    docs = make_docs(*enumerate(texts)).withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 10 == 0)
    seen, vocabulary = hmm.learn_vocabulary(docs)
    shared = spark.sparkContext.broadcast(vocabulary)
    coded = hmm.staged(docs.mapInArrow(hmm._code(shared), hmm._CODED), "test-coded")
    model, states, _ = hmm.train(coded, vocabulary, shared)
    sequences, first = [], []
    for row in coded.where("not held_out").select("ids", "tail_shapes").collect():
        of_id = np.concatenate((vocabulary.classes, 1 + hmm.OWN + np.frombuffer(row.tail_shapes, np.uint8).astype(np.uint16)))
        ids = of_id[np.frombuffer(row.ids, np.int32)]
        for at in range(0, len(ids), 1_000):
            sequences.append(ids[at : at + 1_000])
            first.append(at == 0)
    unigram = vocabulary.unigram()
    want = hmm.Model.random(unigram)
    for _ in range(13):
        want = want.refitted(hmm.expected_counts(want, sequences, np.array(first))[0], unigram)
    assert np.allclose(model.moves, want.moves, rtol=1e-6) and np.allclose(model.emits, want.emits, rtol=1e-6)
    own = set(vocabulary.words[vocabulary.own > 0].view(np.int64).tolist())
    rare = {x.token: x.found for x in seen.where("shape >= 0").collect() if x.token not in own}
    kept = {x.token: x.found for x in states.collect()}
    assert kept == rare and min(rare.values()) == 1


def test_odd_rows_in_the_model(odd_docs):
    assert hmm.scored(odd_docs.limit(0)).count() == 0
    rows = hmm.scored(odd_docs.where("doc_id is not null")).collect()
    assert len(rows) == 10 and all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    nothing = hmm.scored(odd_docs.where("doc_id is null")).collect()[0]  # held out, with nothing to learn from
    assert nothing.held_out and nothing.n_known == 0 and nothing.train_tokens == 0


def test_token_counts_equal_the_library(odd_docs, spark, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHED", 50)
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    more = ["a<|endoftext|> b <|endoftext|>", "x՘y ࢏1 ౜", "tab\t\t x  \n\n y ", "I'll we've '' '", "\x85a　b\x1c c", "¼ ² ٣ 漢字仮名 🤗🏽 é"]
    docs = odd_docs.union(odd_docs.limit(1).crossJoin(spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "i long, x string")).select("i", "x", *odd_docs.columns[2:]))
    got = Counter(token_counts.token_counts(docs, open(path).read()).collect())
    want = Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert got == want
    assert token_counts.token_counts(odd_docs.limit(0), open(path).read()).count() == 0


def test_tokenizers_of_other_kinds_count_as_the_library(odd_docs, spark):
    """Files whose pre-tokens are not the pattern's go to the library whole."""
    spec = json.loads(open(public_tokenizers.path("byte_bpe_50k.json")).read())
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {**spec["pre_tokenizer"], "add_prefix_space": True}}, {"pre_tokenizer": {**spec["pre_tokenizer"], "use_regex": False}}):
        text = json.dumps(spec | change)
        docs = odd_docs.where("length(text) < 1000 or text is null")
        library = Tokenizer.from_str(text)
        want = Counter((r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
        assert Counter((r.doc_id, r.n_tokens) for r in token_counts.token_counts(docs, text).collect()) == want


def test_token_counts_shuffle_nothing(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    counted = token_counts.token_counts(docs, open(public_tokenizers.path("byte_bpe_50k.json")).read())
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in token_counts.sampled_leaders(docs.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()


def test_token_counts_of_the_table(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_tokens, r.over_limit) for r in queries.op6_two_tier(spark, FOLDER).collect()}
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert got[r.doc_id] == (n, n > 1024)


def test_urls(spark):
    given = [
        (1, "https://a.example.org/es/x", "example.org/es/", "block"), (2, "https://example.org/en/1?x", "example.org/en/1", "block"), (3, "http://EXAMPLE.org/en/2", "org/", "allow"),
        (4, "http://org", None, "allow"), (5, "http://x.com/fr/casino", "com/fr/", "allow"), (6, "http://x.com/casino-a", None, "block"), (7, "http://x.com/casinos", None, "allow"),
        (8, "http://x.net/sex/poker", None, "block"), (9, "http://x.net/sex/sex", None, "allow"), (10, "no scheme casino", None, "block"), (11, None, None, "allow"), (12, "http://x.notcom/de/", None, "allow"), (11, None, None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u, _, _ in given], "page_id long, url string, host string, rule string")
    assert Counter((r.page_id, r.rule, r.verdict) for r in judged_urls(pages).collect()) == Counter((i, r, v) for i, _, r, v in given)
    assert judged_urls(pages.limit(0)).count() == 0
    assert [(r.host, r.path) for r in judged_urls(pages.where("page_id = 3")).collect()] == [("example.org", "/en/2")]


def test_main_text_of_the_table(spark):
    import html
    import re

    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").withColumn("text", F.lit("x"))
    got = {r.page_id: (r.text, r.n_chars) for r in main_texts(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?p>|</?h1>", body)]
        want = "\n\n".join(b for b in blocks if b)
        assert got[r.page_id] == (want, len(want))


def test_main_text_of_other_markup(spark):
    page = """<html><head><title>T</title></head><body><div class="menu"><a href=x>Home</a> <a href=y>News</a></div><div class="wrap"><div class="col">
    <h2>Title of this story</h2><p>Some long text of the story, which goes on and on with words &amp; more,<br>until it ends here.<p>Another paragraph, with commas, and some more words in it.
    <div class="advert">Buy this now. It is cheap.</div><p>The last part of the story comes after the advert, and it is long enough.</p></div>
    <div class="sidebar"><p>Other stories that you may like to read today.</p></div></div><section class="comments"><p>I liked this story, it was great and I read it all.</p></section>
    <form><p>Subscribe to our letter</p><button>Go</button></form></body></html>"""
    own = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url", "html")
    odd = spark.createDataFrame([(-1, "u", page), (-2, None, None), (-3, "u", ""), (-4, "u", "<div>" * 3000 + "</p></b>"), (-4, "u", "<div>" * 3000 + "</p></b>")], "page_id long, url string, html string")
    got = [r for r in main_texts(own.union(odd)).collect() if r.page_id < 0]
    assert len(got) == 5
    text = next(r.text for r in got if r.page_id == -1)
    assert text.split("\n\n") == ["Title of this story", "Some long text of the story, which goes on and on with words & more, until it ends here.", "Another paragraph, with commas, and some more words in it.", "The last part of the story comes after the advert, and it is long enough."]
    assert all(r.text == "" and r.n_chars == 0 for r in got if r.page_id in (-2, -3, -4))
    assert main_texts(own.limit(0)).count() == 0
    alone = main_texts(odd.where("page_id = -1")).first().text  # a table in which no page marks its main part
    assert "Some long text of the story" in alone and "The last part of the story" in alone and "Home" not in alone


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<html><head><title>T</title><meta charset=utf-8><body><p>a</p><p>b</p></body></html>", "a\n\nb"),
        ("<head><title>T</title><noscript><img src=x><p>n</p></noscript><p>a</p>b", "a\n\nb"),
        ("<head><title>T</title>a<p>b</p>", "a\n\nb"),
        ("<head><title>T</title><body><div><svg><path d=x><text>s</div><p>a</p><template><i>t</i></body>", "a"),
        ("<div><object><div>o</div>o</div><p>a</p><p>b <noscript>n</p><p>c</p>", "a\n\nb\n\nc"),
        ("<head><title>T</title></head><body><svg><g><svg>s</svg></g>s</svg><p>a</p><object><p>o</object>b</body>", "a\n\nb"),
    ],
)
def test_unclosed_dropped_elements_do_not_swallow_the_page(html, want):
    page = Page(html)
    assert text_of(page, [True] * len(page.tags)) == want


def test_tables_without_marked_pages_have_texts(spark):
    """The same pages with article and main renamed: no empty text, and nearly all blocks as before."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    renamed = pages.withColumn("html", F.regexp_replace("html", r"<(/?)(article|main)\b", "<$1div"))
    want, got = ({r.page_id: r.text for r in main_texts(t).collect()} for t in (pages, renamed))
    assert all(got[i] for i in got if want[i])
    blocks = [(set(want[i].split("\n\n")), set(got[i].split("\n\n"))) for i in got]
    assert sum(len(a & b) for a, b in blocks) >= 0.9 * sum(len(a | b) for a, b in blocks)


@pytest.mark.parametrize("html", ["<div>" * 200_000, "<p><button>" + "<div>" * 100_000 + "</x></b>" * 50_000, "<noscript>" + "<div>" * 100_000 + "</b>" * 50_000 + "</noscript><p>a", "<li><ul>" * 50_000 + "</ol>" * 50_000])
def test_open_tags_cost_linear_time(html):
    began = time.perf_counter()
    page = Page(html)
    text_of(page, decode(page, [1.0] * len(page.tags)))
    features(page)
    assert time.perf_counter() - began < 30


def test_decoding_equals_exhaustive_search():
    """in: taken, children in or out; out: all below out; mixed: itself out, children free."""
    r = random.Random(3)
    below = {"in": ("in", "out"), "out": ("out",), "mixed": ("in", "out", "mixed")}
    for _ in range(60):
        page = Page("".join(r.choice(("<div>", "<section>", "</div>", "</section>", "x ", "<p>y</p>")) for _ in range(10)))
        n = len(page.tags)
        if n > 8:
            continue
        odds = [r.uniform(-2, 2) for _ in range(n)]
        own = {e for e, t, _ in page.pieces if not t.isspace()}

        def worth(i, state, odds=odds, own=own):
            if state == "in":
                return odds[i] * (1 if i in own else WRAPPER)
            if state == "out":
                return -odds[i] if i in own else 0.0
            return min(0.0, -odds[i]) if i in own else -0.01

        best = {}
        for states in itertools.product(below, repeat=n):
            if all(states[i] in below[states[page.parents[i]]] for i in range(1, n)):
                chosen = tuple(s == "in" for s in states)
                best[chosen] = max(best.get(chosen, -1e9), sum(worth(i, s) for i, s in enumerate(states)))
        assert best[tuple(decode(page, odds))] == pytest.approx(max(best.values()))


def test_decoding_is_consistent():
    page = Page("<div>a<p>b</p><p>c</p></div><div>d<p>e</p></div>")
    odds = [0.0, 2.0, 1.0, -3.0, -5.0, 1.0]
    taken = decode(page, odds)
    assert taken[1:] == [True, True, False, False, False] and text_of(page, taken) == "a\n\nb"


def _lines_case(make_docs):
    r = random.Random(3)
    body = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    footer = "Share this  page 12 now with all of your many good friends today " + " ".join(f"note{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(39))
    docs = [(i, f"{body(120)}\n{footer if i % 2 else footer.upper()}") for i in range(1, 31)]
    docs += [(i, f"{body(10)}\n{footer}") for i in range(31, 36)]
    docs += [(i, docs[0][1].replace("friends", "friends")) for i in range(36, 40)]
    docs += [(100 + i, body(100), "other") for i in range(40)] + [(200, None), (201, ""), (202, "a b c " * 40), (202, "a b c " * 40), (None, body(60), None)]
    return make_docs(*docs)


def test_frequent_lines(make_docs):
    docs = _lines_case(make_docs)
    rows = {r.doc_id: r for r in judged(docs).collect()}
    assert all(rows[i].kept for i in [*range(1, 31), *range(36, 40), *range(100, 140), None])
    assert not any(rows[i].kept for i in range(31, 36)) and not rows[31].base_failed
    assert rows[202].base_failed and rows[202].n_repeat_words == 120 and rows[200].base_failed
    kept = kept_documents(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in judged(docs).where("kept").collect())
    cleaned = {r.doc_id: r.text for r in without_frequent_lines(docs).collect()}
    assert "\n" not in cleaned[1] and len(cleaned[1].split()) == 120 and cleaned[200] is None and len(cleaned[31].split()) == 10
    assert judged(docs.limit(0)).count() == kept_documents(docs.limit(0)).count() == 0


def test_odd_rows_in_the_rules(odd_docs):
    rows = judged(odd_docs).collect()
    assert len(rows) == 11
    by_id = {r.doc_id: r for r in rows}
    assert (by_id[1].n_words, by_id[3].n_words, by_id[9].word_chars, by_id[8].word_chars) == (0, 0, 7, 70_000)


def test_mix_meets_its_targets(make_docs):
    r = random.Random(5)
    sources = ["a", "b", "c", "d", None]
    docs = [(i, " ".join(["w"] * r.randrange(0, 400)), r.choices(sources, (60, 20, 10, 9, 1))[0]) for i in range(3000)]
    rows = apportion.mix(make_docs(*docs)).collect()
    assert len(rows) == 3000 and all(0 <= x.taken <= 3 * x.size for x in rows)
    sizes = {s: sum(x.size for x in rows if x.source == s) for s in sources}
    weights, free, rest = dict(zip(sources, (1, 2, 3, 1, 2))), set(sources), float(sum(sizes.values()))
    want = {}
    while True:
        share = {s: weights[s] * rest / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            want |= share
            break
        want |= {s: 3.0 * sizes[s] for s in over}
        rest -= sum(3 * sizes[s] for s in over)
        free -= over
    for s in sources:
        own = [x for x in rows if x.source == s]
        assert own[0].target == pytest.approx(want[s]) and sum(x.taken for x in own) == pytest.approx(want[s], rel=0.02)


def test_small_sources_of_a_large_table_meet_their_targets(make_docs, monkeypatch):
    monkeypatch.setattr(apportion, "BLOCKS", 64)  # as the blocks of a table a thousand times as large
    r = random.Random(8)
    docs = [(i, "w " * r.randrange(100, 400), "large" if i % 2 else "other") for i in range(1000)]
    docs += [(2000 + i, "w " * 40, f"tiny{i % 6}") for i in range(60)]
    rows = apportion.mix(make_docs(*docs)).collect()
    assert len(rows) == len(docs)
    for s in {x.source for x in rows}:
        own = [x for x in rows if x.source == s]
        assert all(x.taken <= 3 * x.size for x in own)
        assert sum(x.taken for x in own) == pytest.approx(own[0].target, rel=0.02)


def test_odd_rows_in_the_mix(odd_docs):
    rows = apportion.mix(odd_docs).collect()
    assert len(rows) == 11 and sum(x.size for x in rows) == 120_000 + 9 + 7 + 1 + 5
    assert all(x.taken <= 3 * x.size for x in rows)
    assert apportion.mix(odd_docs.limit(0)).count() == apportion.mixed_documents(odd_docs.limit(0)).count() == 0
    mixed = apportion.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns and mixed.where("text is null").count() == 0


def test_rows_without_id_are_spread(make_docs):
    docs = make_docs(*[(i if i % 3 else None, f"w{i} " * (5 + i % 7), "a") for i in range(3000)])
    rows = apportion.mix(docs).collect()
    assert len({r.spin for r in rows if r.doc_id is None}) == 1000
    assert all(r.taken <= 3 * r.size for r in rows) and sum(r.taken for r in rows) == pytest.approx(rows[0].target, rel=0.01)


def test_sainte_lague_equals_highest_quotients(spark):
    votes = {"a": 53_000, "b": 24_000, "c": 23_000, "d": 1}
    claims = spark.createDataFrame([(k, float(v), 7, 100) for k, v in votes.items()], "key string, votes double, total long, most long")
    got = {r.key: r.quota for r in apportion.seats(claims, [], ["key"], "votes", "total", "most").collect()}
    best = sorted(((v / (2 * k + 1), n) for n, v in votes.items() for k in range(7)), reverse=True)[:7]
    assert got == Counter(n for _, n in best)


def test_curve_visits_neighbours(spark, monkeypatch):
    monkeypatch.setattr(hilbert, "BITS", 3)
    cells = spark.range(512).selectExpr("id % 8 AS x", "id div 8 % 8 AS y", "id div 64 AS z")
    walk = sorted((r.h, r.x, r.y, r.z) for r in cells.select("*", hilbert.hilbert_index([F.col("x"), F.col("y"), F.col("z")]).alias("h")).collect())
    assert [w[0] for w in walk] == list(range(512))
    assert all(sum(abs(p - q) for p, q in zip(a[1:], b[1:])) == 1 for a, b in zip(walk, walk[1:]))


def test_shards_are_even_and_gapless(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = queries.op10_hilbert(spark, FOLDER).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id]) + 8, zlib.crc32(texts[r.doc_id])) for r in rows)
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    assert {(r.shard, r.slot) for r in rows} == {(s, i) for s, n in counts.items() for i in range(n)}


def test_shards_can_be_skipped(spark):
    """Readers of one source, or of a tenth of the sizes, open few shards more by minimum and maximum than hold such rows."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = hilbert.shard_numbers(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    for value in (lambda r: r.source or "", lambda r: r.size):
        shards = {}
        for r in rows:
            shards.setdefault(r.shard, []).append(value(r))
        ranked = sorted(map(value, rows))
        held = opened = 0
        for k in range(10):
            low, high = ranked[len(ranked) * k // 10], ranked[len(ranked) * (k + 1) // 10 - 1]
            held += sum(any(low <= v <= high for v in s) for s in shards.values())
            opened += sum(min(s) <= high and max(s) >= low for s in shards.values())
        assert opened <= 1.5 * held and opened < 0.7 * 10 * 24, (held, opened)


def test_odd_rows_in_shards(odd_docs):
    rows = hilbert.shard_numbers(odd_docs).collect()
    assert len(rows) == 11 and len({(r.shard, r.slot) for r in rows}) == 11
    assert Counter(r.text_crc32 for r in rows)[0] == 2
    sharded = hilbert.sharded_documents(odd_docs)
    assert sharded.columns == [c for c in odd_docs.columns if c != "shard"] + ["shard", "slot"]
    assert sharded.count() == 11 and hilbert.shard_numbers(odd_docs.limit(0)).count() == 0


def test_word_hashes(monkeypatch):
    import re

    import tenurekit.llm.words as kernel

    texts = ["Aa b\tC aa", None, "", "x" * 200 + " " + "x" * 136 + "y" + "x" * 63, "é1-É2 ß", "a b c d e f g h"]
    raw = [t and t.encode() for t in texts]
    for kinds, pattern in ((NOT_BLANK, rb"[^\x20\x09-\x0D]+"), (LETTERS_DIGITS, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        hashes, offsets = word_hashes(raw, kinds)
        own = [re.findall(pattern, (t or b"").lower()) for t in raw]
        assert np.diff(offsets).tolist() == [len(w) for w in own]
        seen = dict(zip([w for ws in own for w in ws], hashes.tolist(), strict=False))
        assert [seen[w] for ws in own for w in ws] == hashes.tolist() and len(set(seen.values())) == len(seen)
        monkeypatch.setattr(kernel, "CHUNK_BYTES", 7)
        again, cuts = word_hashes(raw, kinds)
        monkeypatch.undo()
        assert (again == hashes).all() and (cuts == offsets).all()
    assert len(grams(hashes[:3], 5)) == 0


def test_rows_of_numbers_are_told_apart(make_docs):
    """Lines that are mostly digits keep them; page numbers and dates in other lines do not count."""
    r = random.Random(4)
    table = lambda: "\n".join(" ".join(str(r.randrange(10**4)) for _ in range(12)) for _ in range(10))
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(8)) for _ in range(n))
    docs = [(i, table()) for i in range(40)] + [(100 + i, f"{prose(60)}\nPage {i} of the {2000 + i} report, printed on day {i}") for i in range(40)]
    docs += [(200 + i, f"{prose(45)}\npage {i} of the {i} report, printed on day {i}") for i in range(3)]
    rows = {x.doc_id: x for x in judged(make_docs(*docs)).collect()}
    assert all(rows[i].kept and rows[i].n_left == 120 for i in range(40))
    assert all(rows[i].kept and rows[i].n_left == 60 for i in range(100, 140))
    assert all(not rows[i].kept and not rows[i].base_failed for i in range(200, 203))  # 45 words are left


def test_a_line_in_a_small_share_of_a_large_host_goes(make_docs):
    r = random.Random(6)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(8)) for _ in range(n))
    docs = [(i, f"{prose(60)}\nSubscribe to our letter" if i < 25 else f"{prose(60)}\nonly nineteen {'times' if i < 44 else prose(1)}") for i in range(1500)]
    cleaned = {x.doc_id: x for x in cleaned_documents(make_docs(*docs)).collect()}
    assert len(cleaned) == 1500 and not any("Subscribe" in x.text for x in cleaned.values())
    assert sum("nineteen times" in x.text for x in cleaned.values()) == 19 and all(x.n_chars == len(x.text) for x in cleaned.values())
    assert cleaned[0].row == "r" and cleaned[0].t == "t"


def test_the_table_of_pieces_is_bounded_before_it_reaches_the_driver(spark, monkeypatch):
    """Leaders are added up by Spark; ties follow the piece."""
    monkeypatch.setattr(token_counts, "TABLE", 3)
    docs = spark.createDataFrame([(i, "b a c" if i % 2 else "b a d") for i in range(8)], "doc_id bigint, text string")
    assert token_counts.most_frequent(docs) == [" a", "b", " c"]


def test_whole_rows_on_the_curve_are_stored_small(make_docs):
    docs = make_docs(*((i, f"text {i}") for i in range(50)))
    files = [f for f in hilbert.sharded_documents(docs).inputFiles() if "hilbert-parts" not in f]
    assert files and all(".zstd." in f for f in files)
