"""Main text of web pages by gradient-boosted trees over DOM elements and a hierarchical decoding.

There are no labelled pages, so the trees learn from the pages' own structure: in a bounded sample of pages, what stands in
``article`` or ``main`` is main text and the rest is not. Each sample page is also shown in variants in which these tags
become plain ``div`` elements with or without telling names, and menus, sidebars, notices, adverts, forms and reader comments
of other names and makes are put in, around and inside the article; so no single tag or name decides. Where no page of the
table has such a tag, sample pages are labelled by where their paragraphs and telling names lie (``dom.guessed``).
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenurekit.llm.batches import rows
from tenurekit.llm.dom import Page, decode, features, guessed, text_of
from tenurekit.llm.scratch import staged

#: Pages that the trees learn from, and variants of each.
SAMPLE, VARIANTS = 300, 5
TREES, DEPTH = 20, 4

_MARK = "tk-main"
_INSERTS = (
    '<aside class="{n}"><h3>{h}</h3><p>{s}</p><ul><li><a href="/a">{w}</a></li><li><a href="/b">{h}</a></li></ul></aside>',
    '<div class="{n}"><p>{s}</p><p>{h}</p></div>',
    '<div id="{n}">{s}</div>',
    '<section class="{n}"><h2>{w}</h2><div><p><b>{w}</b> {s}</p></div><div><p>{s} {h}</p></div></section>',
    '<form action="/s" class="{n}"><label>{w}</label><input name="q"><button>{w}</button><p>{h}</p></form>',
    '<ul class="{n}"><li><a href="/1">{w}</a></li><li><a href="/2">{h}</a></li><li><a href="/3">{w}</a></li></ul>',
    '<header class="{n}"><h2>{w}</h2><p>{h}</p></header>',
)
#: Tags that tell their kind without a name.
_TELLING = ("<aside", "<form", "<header")
_NAMES = ("sidebar", "side-bar widget", "cookie-notice", "notice", "alert warning", "ad", "ads-banner", "advert", "promo", "sponsored", "comments", "comment-list", "user-comment", "share social", "related-posts", "newsletter subscribe", "menu", "navbar", "breadcrumbs", "header top", "footer", "login-form", "search", "tags", "pagination", "recommended")
_BODIES = ('div class="content"', 'div id="main-content"', 'div class="post-body"', 'div class="entry"', 'section class="story"', 'div class="article-text"', "main", "div", 'div class="page"', "section")

_WITHIN = ("</p><h2>{h}</h2><p>", "</p><h3>{h}</h3><p>", "</p><ul><li>{h}</li><li>{s}</li></ul><p>", "</p><blockquote><p>{s}</p></blockquote><p>", "</p><table><tr><td>{h}</td><td>{s}</td></tr></table><p>", "</p><figure><figcaption>{h}</figcaption></figure><p>")
_PLAIN = ("div", 'div class="col"', 'div class="inner"', "section", "td")


def variant(html: str, r: random.Random, sentences: list[str]) -> str:
    """The page with its main part marked, renamed and mixed with other parts."""

    def part() -> str:
        words = r.choice(sentences).split() or ["-"]
        made = r.choice(_INSERTS)
        name = "" if made.startswith(_TELLING) and r.random() < 0.6 else r.choice(_NAMES)
        filled = made.format(n=name, s=" ".join(words[:40]), h=" ".join(words[:6]), w=words[0])
        return f"<!--+-->{filled}<!---->"

    opened = re.search(r"<(article|main)\b[^>]*>", html)
    if not opened:
        return html
    tag = opened[1]
    end = html.rfind(f"</{tag}>")
    head, body, rest = html[: opened.start()], html[opened.end() : end if end > 0 else len(html)], html[end + len(tag) + 3 :] if end > 0 else ""
    if r.random() < 0.5:
        head = re.sub(r"<(/?)nav\b", r"<\1div", head) if r.random() < 0.5 else head.replace("<nav", '<nav class="menu"')
        rest = re.sub(r"<footer\b", '<div class="footer"', rest).replace("</footer>", "</div>")
    if r.random() < 0.3:
        body = "<p>".join(body.split("<p>")[: r.randrange(2, 6)])
    body = body.replace("h1>", f"{r.choice(('h1', 'h1', 'h2', 'h3'))}>")
    if r.random() < 0.5:
        words = r.choice(sentences).split() or ["-"]
        inner = r.choice(_WITHIN).format(s=" ".join(words[:40]), h=" ".join(words[:6]))
        body = inner.join(body.rsplit("<p>", 1)) if "<p>" in body else body + inner
    around = lambda: "".join(part() for _ in range(r.choice((0, 1, 1, 2))))
    if r.random() < 0.6:
        blocks = re.split(r"(?=<p>)", body)
        spot = r.randrange(len(blocks)) + 1
        body = "".join(blocks[:spot]) + "</p>" + part() + "".join(blocks[spot:])
    if r.random() < 0.4:
        body += "</p>" + part()
    kind = r.choice(_PLAIN if r.random() < 0.5 else _BODIES)
    outer = r.choice(("", "", "div", 'div class="wrap"', 'div class="row"'))
    main = f'{around()}<{kind} data-{_MARK}="1">{body}</{kind.split()[0]}>{around()}'
    return f"{head}<{outer}>{main}</div>{rest}" if outer else head + main + rest


class _Marked(Page):
    """A page whose elements know whether they are main text."""

    def __init__(self, html: str) -> None:
        self.label = [0]
        self.added = 0
        super().__init__(html)

    def handle_comment(self, data: str) -> None:
        self.added += {"+": 1, "": -1}.get(data, 0)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        before = len(self.tags)
        super().handle_starttag(tag, attrs)
        if len(self.tags) > before:
            starts = tag in ("article", "main") or any(k == f"data-{_MARK}" for k, _ in attrs)
            self.label.append(int(not self.added and (starts or self.label[self.parents[-1]] == 1)))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    htmls = [h for batch in batches for h in batch.column(0).to_pylist() if h]
    sentences = [t.strip() for h in htmls[:100] for t in re.findall(r">([^<>]{20,400})<", h)] or ["- - -"]
    r = random.Random(11)
    for html in htmls:
        for k in range(1 + VARIANTS):
            page = _Marked(variant(html, r, sentences) if k else html)
            around = {page.parents[i] for i, y in enumerate(page.label) if y}
            for i in range(len(page.tags) - 1, 0, -1):
                around |= {page.parents[i]} if i in around else set()
            # what stands around main text is neither
            kept = [(f, y) for i, (f, y) in enumerate(zip(features(page), page.label, strict=True)) if f[0] > 0 and (y or i not in around)]
            if kept:
                yield rows("features array<double>, label double", features=[f for f, _ in kept], label=[float(y) for _, y in kept])


def _guessed_examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for html in batch.column(0).to_pylist():
            page = Page(html or "")
            kept = [(f, y) for f, y in zip(features(page), guessed(page), strict=True) if f[0] > 0]
            if kept:
                yield rows("features array<double>, label double", features=[f for f, _ in kept], label=[float(y) for _, y in kept])


def _trees(text: str) -> list[list]:
    """Trees of a fitted model, from its printed form: [feature, limit, left, right], or the value of a leaf; left where value <= limit."""
    out: list[list] = []
    for part in re.split(r"Tree \d+ \(weight [^)]*\):", text)[1:]:
        lines = iter([line.strip() for line in part.strip().splitlines()])

        def read(lines=lines):
            line = next(lines)
            if found := re.match(r"Predict: (\S+)", line):
                return float(found[1])
            feature, limit = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
            left = read()
            next(lines)
            return [int(feature), float(limit), left, read()]

        out.append(read())
    return out


def fitted(pages: DataFrame) -> list[tuple[float, list]]:
    """(weight, tree) of trees fitted to SAMPLE pages at most, drawn by a hash of their html; one constant tree where there is
    no text to learn from, or where all sample pages are main text throughout or nowhere."""
    drawn = [F.xxhash64("html"), F.col("html")]
    marked = pages.select("html").where("html rlike '<(article|main)'").orderBy(*drawn).limit(SAMPLE).coalesce(1)
    schema = "features array<double>, label double"
    examples = staged(marked.mapInArrow(_examples, schema), "dom-examples")
    if len(examples.select("label").distinct().take(2)) < 2:
        others = pages.select("html").where("html is not null").orderBy(*drawn).limit(SAMPLE).coalesce(1)
        examples = staged(others.mapInArrow(_guessed_examples, schema), "dom-guessed")
        labels = [r.label for r in examples.select("label").distinct().take(2)]
        if len(labels) < 2:
            return [(1.0, 1.0 if labels == [1.0] else -1.0)]
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=3, cacheNodeIds=False).fit(examples.select(array_to_vector("features").alias("features"), "label"))
    return list(zip(model.treeWeights, _trees(model.toDebugString), strict=True))


def _odds(trees: list[tuple[float, list]], row: list[float]) -> float:
    total = 0.0
    for weight, node in trees:
        while isinstance(node, list):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        total += weight * node
    return 2 * total


_TEXTS = "page_id bigint, url string, text string, n_chars bigint"


def _extract(shared: object) -> Callable:
    def one(html: str | None) -> str:
        page = Page(html or "")
        return text_of(page, decode(page, [_odds(shared.value, f) if f[0] > 0 else 0.0 for f in features(page)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [one(h) for h in part.column(2).to_pylist()]
                yield rows(_TEXTS, page_id=part.column(0), url=part.column(1).to_pylist(), text=texts, n_chars=[len(t) for t in texts])

    return run


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages.

    Null and empty html give an empty text. Repeated rows are extracted each for itself; an empty table gives no rows. Broken markup never fails. Other columns
    are ignored.
    """
    pages = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    trees = pages.sparkSession.sparkContext.broadcast(fitted(pages))
    return pages.mapInArrow(_extract(trees), _TEXTS)
