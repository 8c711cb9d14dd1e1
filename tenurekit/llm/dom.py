"""Pages as arrays of block elements, with features for each."""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
DROPPED = frozenset("head iframe noscript object script style svg template title".split())
#: Tags that can stand in head. Any other tag, or text, ends a head that is not closed.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: A start tag ends an open element of these kinds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KEEPS_P = INLINE | {"body", "html", "label", "button", "input", "select", "textarea", "option"}
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
KINDS = (frozenset({"p", "blockquote", "pre"}), HEADINGS, frozenset({"ul", "ol", "li", "dl", "dt", "dd"}), frozenset({"div"}), frozenset({"article", "main"}), frozenset({"section"}), frozenset({"nav", "aside", "footer"}), frozenset({"header"}), frozenset({"form", "fieldset", "button", "input", "select", "textarea", "label", "option", "dialog"}), frozenset({"table", "tbody", "thead", "tr", "td", "th", "figure", "figcaption"}))
GOOD = frozenset("article body content entry main post story text page paragraph prose read".split())
BAD = frozenset("ad ads advert advertisement adv banner breadcrumb breadcrumbs bar comment comments consent cookie cookies disqus footer form foot header head links login masthead menu meta modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted recommended related reply respond search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar top warning widget alert author byline".split())
#: Weight of an element without text of its own.
WRAPPER = 0.25
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page(HTMLParser):
    """tags, parents, attribute tokens and depths of block elements in page order (0 is the page itself), and text pieces (element, text, in a link).

    Never fails: unknown, unclosed and crossing tags are taken as browsers do, roughly.
    """

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.tokens, self.depths = ["page"], [-1], [()], [0]
        self.pieces: list[tuple[int, str, bool]] = []
        self.breaks: set[int] = set()  # pieces in front of which a block begins
        self.open: list[tuple[str, int]] = [("page", 0)]
        self.places: dict[str, list[int]] = {}  # where each tag is open, so that no tag is looked for down the whole stack
        self.dropping: list[str] = []  # a dropped element and what is open in it
        self.dropped: Counter[str] = Counter()
        self.links = 0
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.dropping[:1] == ["head"] and (tag == "body" or len(self.dropping) == 1 and tag not in IN_HEAD):
            self._drop_no_more()
        if self.dropping or tag in DROPPED:
            if tag not in VOID and not (self.dropping and tag in ("head", "html")):
                self.dropping.append(tag)
                self.dropped[tag] += 1
            return
        if tag not in KEEPS_P:
            self._end_back_to({"p"}, {"table", "td", "button", "li"})
        if tag in ENDS:
            self._end_back_to(ENDS[tag], {"ul", "ol", "dl", "table", "select"} if tag not in ("td", "th") else {"tr", "table"})
        if tag in INLINE:
            if tag in ("br", "wbr"):
                self.handle_data(" ")
            elif tag not in VOID:
                self._push(tag, self.open[-1][1])
                self.links += tag == "a"
            return
        text = " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "itemprop", "aria-label"))
        self.tags.append(tag)
        self.parents.append(self.open[-1][1])
        self.depths.append(self.depths[self.open[-1][1]] + 1)
        self.tokens.append(tuple(t.lower() for t in _TOKEN.findall(text)))
        self.breaks.add(len(self.pieces))
        if tag not in VOID:
            self._push(tag, len(self.tags) - 1)

    def _push(self, tag: str, element: int) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, element))

    def _last(self, tags: set) -> int:
        """Where one of the tags was opened last; 0 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _end_back_to(self, tags: set, stops: set) -> None:
        at = self._last(tags)
        if at > self._last(stops):
            self._pop(at)

    def _drop_no_more(self) -> None:
        self.dropping.clear()
        self.dropped.clear()

    def _pop(self, at: int) -> None:
        for tag, _ in self.open[at:]:
            self.places[tag].pop()
            self.links -= tag == "a"
            if tag not in INLINE:
                self.breaks.add(len(self.pieces))
        del self.open[at:]

    def handle_endtag(self, tag: str) -> None:
        if self.dropped[tag]:
            while self.dropping[-1] != tag:
                self.dropped[self.dropping.pop()] -= 1
            self.dropped[self.dropping.pop()] -= 1
            return
        # what is not open in a dropped element may be its parent, and ends it too
        at = self._last({tag})
        if at:
            self._drop_no_more()
            self._pop(at)

    def handle_data(self, data: str) -> None:
        if self.dropping == ["head"] and not data.isspace():
            self._drop_no_more()
        if not self.dropping:
            self.pieces.append((self.open[-1][1], data, self.links > 0))


def guessed(page: Page) -> list[int]:
    """For each element of a page that names no main part, whether it looks like main text: 1 within the element whose own
    paragraphs hold the most text outside links, but for parts of it that are named or made like menus, notices and forms."""
    n = len(page.tags)
    size, linked = [0] * n, [0] * n
    for element, text, in_link in page.pieces:
        chars = len(text.strip())
        size[element] += chars
        linked[element] += chars * in_link
    odd = [False] * n
    score = [0.0] * n
    for i in range(1, n):
        up = page.parents[i]
        names = set(page.tokens[i])
        odd[i] = odd[up] or page.tags[i] in KINDS[6] or page.tags[i] in KINDS[8] or len(names & BAD) > len(names & GOOD)
        if odd[i]:
            continue
        plain = size[i] - 2 * linked[i]
        score[i] += plain / 2
        if page.tags[i] in KINDS[0] or page.tags[i] in KINDS[1] or page.tags[i] in KINDS[2]:
            score[up] += plain
            score[max(0, page.parents[up])] += plain / 2
    main = max(range(n), key=lambda i: (score[i], -i))
    out = [0] * n
    for i in range(n):
        out[i] = int(score[main] > 0 and not odd[i] and (i == main or i > 0 and out[page.parents[i]] == 1))
    return out


def features(page: Page) -> list[list[float]]:
    """A row for each element: density of its subtree, attribute tokens, depth, and how it stands among its siblings."""
    n = len(page.tags)
    chars, links, words, marks, own, start = ([0] * n for _ in range(6))
    below, children = [0] * n, [0] * n
    at = 0
    for element, text, linked in page.pieces:
        size = len(text) - text.count(" ")
        own[element] += size
        chars[element] += size
        links[element] += size * linked
        words[element] += len(text.split())
        marks[element] += sum(map(text.count, ".,;:!?"))
    for i in range(n):
        start[i] = at
        at += own[i]
    for i in range(n - 1, 0, -1):
        up = page.parents[i]
        for column in (chars, links, words, marks):
            column[up] += column[i]
        below[up] += below[i] + 1
        children[up] += 1
    alike: dict[tuple[int, str], list[int]] = {}
    for i in range(1, n):
        alike.setdefault((page.parents[i], page.tags[i]), []).append(chars[i])
    good, bad = [0] * n, [0] * n
    above: list[tuple] = [(0, 0, 0, 0)] * n
    out = []
    for i in range(n):
        up = max(0, page.parents[i])
        good[i], bad[i] = (len({t for t in page.tokens[i] if t in names}) for names in (GOOD, BAD))
        kinds = [float(page.tags[i] in kind) for kind in KINDS]
        g, b, inside, around = above[up]
        above[i] = (max(g, good[i]), max(b, bad[i]), max(inside, page.tags[i] in KINDS[4]), max(around, page.tags[i] in KINDS[6] or page.tags[i] in KINDS[8]))
        same = alike.get((page.parents[i], page.tags[i]), [chars[i]])
        row = [
            math.log1p(chars[i]), math.log1p(words[i]), links[i] / max(1, chars[i]), math.log1p(chars[i] / (1 + below[i])), marks[i] / max(1, words[i]), float(page.depths[i]),
            float(children[i]), chars[i] / max(1, chars[up]), chars[i] / max(1, chars[0]), float(len(same)), math.log1p(sum(same) / len(same)), start[i] / max(1, at),
            own[i] / max(1, chars[i]), float(good[i]), float(bad[i]), float(g), float(b), float(inside), float(around), math.log1p(chars[up]), links[up] / max(1, chars[up]), *kinds,
        ]
        out.append(row)
    return out


def decode(page: Page, odds: list[float]) -> list[bool]:
    """Which elements' own text is taken: the best choice in which nothing below a rejected element is taken.

    An element is in (with each child in or out), out with all below, or mixed (itself out, its children free). odds: log-odds of
    being in. They count in full for elements with text of their own; those that only hold others weigh WRAPPER as much
    when they are in, and nothing when they are out or mixed.
    """
    n = len(page.tags)
    own = [False] * n
    for element, text, _ in page.pieces:
        own[element] = own[element] or not text.isspace()
    inside = [o if own[i] else WRAPPER * o for i, o in enumerate(odds)]
    outside, mixed = [-o if own[i] else 0.0 for i, o in enumerate(odds)], [-0.01 if not own[i] else min(0.0, -o) for i, o in enumerate(odds)]
    for i in range(n - 1, 0, -1):
        up = page.parents[i]
        outside[up] += outside[i]
        inside[up] += max(inside[i], outside[i])
        mixed[up] += max(inside[i], outside[i], mixed[i])
    state = ["" for _ in range(n)]
    for i in range(n):
        above = state[page.parents[i]] if i else "mixed"
        if above == "out":
            state[i] = "out"
        elif above == "in":
            state[i] = "in" if inside[i] > outside[i] else "out"
        else:
            state[i] = "out" if outside[i] >= max(inside[i], mixed[i]) else "in" if inside[i] >= mixed[i] else "mixed"
    return [s == "in" for s in state]


def text_of(page: Page, taken: list[bool]) -> str:
    """Blocks of the taken elements in page order, white space as one space, joined by two line feeds."""
    blocks: list[list[str]] = [[]]
    for k, (element, text, _) in enumerate(page.pieces):
        if k in page.breaks:
            blocks.append([])
        if taken[element]:
            blocks[-1].append(text)
    joined = (" ".join("".join(b).split()) for b in blocks)
    return "\n\n".join(b for b in joined if b)
