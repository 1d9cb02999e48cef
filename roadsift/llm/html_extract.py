"""Main text of web pages: flat text blocks classified by a decision tree.

The page is cut at block-level tags into flat blocks of text.  A block's features are its
own word count and link density, those of its neighbours, whether it is a heading, and the
container it stands in: article, page furniture by its element (nav, footer, ...), or only
by class, id and role words or as a form.  Words of attributes are soft evidence: they do
not count on ``html``, ``body``, ``article`` and ``main``, nor on anything that holds an
article, and their container's share of the page's words is a feature beside them, so a
wrapper that holds most of a page is not furniture for its name.  A CART tree, trained in
numpy on the small labelled table below, decides whether a block is main text.

Scale: one Arrow pass over the pages, no shuffle; a page is scanned tag by tag in time
linear in its length, and pages come in slices of bounded bytes.

Edge cases: null html is empty and gives an empty text; unclosed tags, stray end tags, a
cut-off last tag and quotes that are never closed are read as browsers do, roughly;
repeated pages are extracted once each; result columns win over carried columns of the
same name; an empty table gives an empty result.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ids_field, others, quoted, slices

RESULT = ("text", "n_chars")

# HTML element names.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noframes ol optgroup option p pre section select summary table tbody td template textarea tfoot th thead title tr ul video audio".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = frozenset("script style noscript template iframe object svg head title textarea select button option canvas audio video map math".split())
RAW_TAGS = frozenset("script style textarea title".split())
FURNITURE_TAGS = frozenset("nav footer aside menu dialog header".split())
PLAIN_TAGS = frozenset("html body article main".split())
CLOSES_P = BLOCK_TAGS - frozenset("br button td th body html".split())
#: Words of class and id attributes and of ARIA roles that name page furniture or reader comments.
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendation recommendations sidebar side rail widget nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer foot header masthead topbar toolbar comment comments comentarios commentaires kommentare discussion replies reply respond disqus copyright legal disclaimer tags taglist skip hidden contentinfo complementary search".split()
)
ARTICLE_WORDS = frozenset("article content main story post entry body text".split())
COMMENT_WORDS = frozenset("comment comments comentarios commentaires kommentare discussion replies reply respond disqus".split())
#: First words of class names that say what a page or text has, not what the element is; last words that name pictures.
HAVING_WORDS = frozenset("has with no without is in category tag type format layout".split())
PICTURE_WORDS = frozenset("image images img photo photos picture figure caption".split())
#: Attributes that stand without a value on one-letter elements; others mean a comparison, as in a<b and c>d.
BARE_WORDS = frozenset("hidden download inert itemscope autofocus nofollow contenteditable".split())

_PLAIN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)\s*(/?)>")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[^\s/>][^\s/>=]*")
_GAP, _SPACES, _BARE_VALUE = re.compile(r"[\s/]*"), re.compile(r"\s*"), re.compile(r"[^\s>]*")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_SPACE = re.compile(r"\s+")
_RAW_END = {t: re.compile(rf"</{t}\s*[^>]*(?:>|\Z)", re.I) for t in RAW_TAGS}

OUTSIDE, ARTICLE, SOFT, FURNITURE = 0, 1, 2, 3
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "container", "heading", "share")

# Labelled blocks: the features in the order of FEATURES, then 1 for main text. Written for this table.
# Containers: 0 none, 1 article, 2 furniture by attribute words or a form, 3 furniture by element.
LABELLED = """
220 0.00 0 0.00 180 0.00 1 0 0.00 1
80 0.00 220 0.00 60 0.02 1 0 0.00 1
60 0.02 80 0.00 0 0.00 1 0 0.00 1
1 0.00 9 0.00 40 0.00 1 0 0.00 1
2 0.00 1 0.00 2 0.00 1 0 0.00 1
8 0.00 12 0.00 90 0.00 1 1 0.00 1
7 0.00 0 0.00 7 0.00 1 1 0.00 1
1 0.00 4 0.00 1 0.00 1 1 0.00 1
35 0.15 60 0.00 44 0.00 1 0 0.00 1
12 0.50 60 0.00 44 0.00 1 0 0.00 1
3 0.00 100 0.00 12 0.00 1 0 0.00 1
5 1.00 60 0.00 44 0.00 1 0 0.00 1
6 1.00 5 1.00 6 1.00 1 0 0.00 0
2 1.00 1 1.00 2 1.00 1 0 0.00 0
3 1.00 4 1.00 2 1.00 1 0 0.00 0
1 1.00 1 1.00 1 1.00 1 0 0.00 0
400 0.00 8 0.00 12 0.10 1 0 0.00 1
1500 0.01 8 0.00 12 0.10 1 0 0.00 1
15 0.00 2 0.00 4 0.00 1 0 0.00 1
8 0.00 1 1.00 90 0.00 1 1 0.00 1
60 0.00 2 1.00 40 0.00 1 0 0.00 1
2 0.00 2 1.00 1 0.00 1 0 0.00 1
1 0.00 3 1.00 0 0.00 1 0 0.00 1
300 0.02 1 1.00 0 0.00 1 0 0.00 1
20 0.10 6 1.00 3 1.00 1 0 0.00 1
2 0.00 1 0.00 1 1.00 1 0 0.00 1
40 0.00 90 0.00 2 1.00 1 0 0.00 1
4 0.00 2 1.00 1 1.00 1 0 0.00 1
9 0.00 3 1.00 1 1.00 1 1 0.00 1
1 0.00 2 1.00 3 1.00 1 0 0.00 1
300 0.00 2 1.00 1 1.00 1 0 0.00 1
3 0.00 0 0.00 0 0.00 0 0 0.00 1
200 0.00 0 0.00 0 0.00 0 0 0.00 1
1 0.00 0 0.00 0 0.00 1 0 0.00 1
5 0.00 90 0.00 1 1.00 1 0 0.00 1
25 0.00 30 0.00 25 0.00 1 0 0.00 1
120 0.00 0 0.00 95 0.00 0 0 0.00 1
95 0.03 120 0.00 130 0.00 0 0 0.00 1
130 0.00 95 0.03 5 0.80 0 0 0.00 1
45 0.05 130 0.00 60 0.00 0 0 0.00 1
30 0.00 45 0.05 45 0.00 0 0 0.00 1
9 0.00 4 1.00 120 0.00 0 1 0.00 1
14 0.00 120 0.00 95 0.00 0 0 0.00 1
11 0.00 60 0.00 80 0.00 0 0 0.00 1
6 0.00 70 0.00 80 0.00 0 0 0.00 1
22 0.00 70 0.00 3 1.00 0 0 0.00 1
1 1.00 1 1.00 1 1.00 0 0 0.00 0
2 1.00 1 1.00 2 1.00 0 0 0.00 0
3 1.00 2 1.00 1 1.00 0 0 0.00 0
5 0.80 3 1.00 2 1.00 0 0 0.00 0
9 0.90 5 0.80 12 0.70 0 0 0.00 0
12 0.70 9 0.90 4 1.00 0 0 0.00 0
40 0.60 12 0.70 9 0.90 0 0 0.00 0
4 0.00 2 1.00 3 1.00 0 0 0.00 0
6 0.00 1 1.00 0 0.00 0 0 0.00 0
8 0.00 3 1.00 5 0.80 0 0 0.00 0
3 0.00 4 0.00 2 1.00 0 1 0.00 0
1 0.00 2 1.00 2 1.00 3 0 0.00 0
3 1.00 2 1.00 3 1.00 3 0 0.00 0
14 0.00 3 1.00 9 0.00 3 0 0.00 0
40 0.00 3 1.00 200 0.00 3 0 0.00 0
90 0.02 60 0.00 40 0.00 3 0 0.00 0
220 0.00 80 0.00 0 0.00 3 0 0.00 0
12 0.00 80 0.00 0 0.00 3 1 0.00 0
25 0.10 130 0.00 0 0.00 3 0 0.00 0
9 0.00 0 0.00 8 0.00 3 0 0.00 0
6 0.00 220 0.00 60 0.00 3 0 0.00 0
1000 0.00 220 0.00 60 0.00 3 0 0.00 0
1 0.00 2 1.00 2 1.00 2 0 0.01 0
3 1.00 2 1.00 3 1.00 2 0 0.02 0
14 0.00 3 1.00 9 0.00 2 0 0.05 0
40 0.00 3 1.00 200 0.00 2 0 0.10 0
90 0.02 60 0.00 40 0.00 2 0 0.30 0
220 0.00 80 0.00 0 0.00 2 0 0.40 0
12 0.00 80 0.00 0 0.00 2 1 0.20 0
1000 0.00 220 0.00 60 0.00 2 0 0.45 0
200 0.00 0 0.00 0 0.00 2 0 0.00 0
25 0.10 130 0.00 0 0.00 2 0 0.05 0
220 0.00 0 0.00 180 0.00 2 0 0.95 1
80 0.00 220 0.00 60 0.02 2 0 0.80 1
45 0.05 130 0.00 60 0.00 2 0 1.00 1
20 0.00 2 1.00 30 0.00 2 0 0.60 1
9 0.00 4 1.00 120 0.00 2 1 0.90 1
14 0.00 120 0.00 95 0.00 2 0 0.75 1
12 0.00 60 0.00 80 0.00 2 0 1.00 1
1 1.00 1 1.00 1 1.00 2 0 0.90 0
2 1.00 1 1.00 2 1.00 2 0 0.75 0
9 0.90 5 0.80 12 0.70 2 0 0.60 0
40 0.60 12 0.70 9 0.90 2 0 1.00 0
4 0.00 2 1.00 3 1.00 2 0 0.80 0
22 0.00 24 0.00 4 0.00 2 0 0.85 1
24 0.00 2 1.00 22 0.00 2 0 0.85 1
22 0.00 24 0.00 0 0.00 2 0 0.70 1
60 0.00 30 0.00 4 0.00 2 0 0.95 1
8 0.00 30 0.00 40 0.00 2 0 0.90 1
"""


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    rows = np.asarray([[float(x) for x in line.split()] for line in LABELLED.strip().splitlines()])
    return rows[:, :-1], rows[:, -1].astype(np.int64)


class Tree:
    """Binary CART tree by Gini impurity; ``value`` is the share of main text in a leaf."""

    def __init__(self, depth: int = 9, least: int = 1):
        self.depth, self.least = depth, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Tree:
        self.feature, self.cut, self.low, self.high, self.value = [], [], [], [], []
        self._grow(x, y, 0)
        self.arrays = tuple(np.asarray(a) for a in (self.feature, self.cut, self.low, self.high, self.value))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        me = len(self.value)
        for column, start in zip((self.feature, self.cut, self.low, self.high, self.value), (-1, 0.0, -1, -1, float(y.mean())), strict=True):
            column.append(start)
        best = (0.0, -1, 0.0)
        if depth < self.depth and 0 < y.sum() < len(y):
            own = len(y) * self._gini(y.mean())
            for f in range(x.shape[1]):
                order = np.argsort(x[:, f], kind="stable")
                v, c = x[order, f], np.cumsum(y[order])
                n = np.arange(1, len(y) + 1)
                at = np.flatnonzero((v[1:] > v[:-1]) & (n[:-1] >= self.least) & (len(y) - n[:-1] >= self.least))
                if len(at):
                    left, right = n[at], len(y) - n[at]
                    gain = own - left * self._gini(c[at] / left) - right * self._gini((c[-1] - c[at]) / right)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0] + 1e-12:
                        best = (float(gain[k]), f, float((v[at[k]] + v[at[k] + 1]) / 2))
        if best[1] >= 0:
            side = x[:, best[1]] <= best[2]
            self.feature[me], self.cut[me] = best[1], best[2]
            self.low[me] = self._grow(x[side], y[side], depth + 1)
            self.high[me] = self._grow(x[~side], y[~side], depth + 1)
        return me

    @staticmethod
    def _gini(p: np.ndarray | float) -> np.ndarray | float:
        return 2 * p * (1 - p)

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, cut, low, high, value = self.arrays
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth + 1):
            inner = feature[at] >= 0
            if not inner.any():
                break
            f = np.maximum(feature[at], 0)
            goes = np.where(x[np.arange(len(x)), f] <= cut[at], low[at], high[at])
            at = np.where(inner, goes, at)
        return value[at]


def trained_tree() -> Tree:
    return Tree().fit(*labelled_table())


class _Tag:
    """A tag: name, whether it ends an element or itself, where it stops, and the words of its class, id and role."""

    __slots__ = ("closing", "empty", "hints", "name", "stop")

    def __init__(self, name: str, closing: bool, empty: bool, stop: int, hints: str = ""):
        self.name, self.closing, self.empty, self.stop, self.hints = name.lower(), closing, empty, stop, hints.lower()


class _Scanner:
    """Tags of a page by the states of the HTML tokenizer; every character is passed a bounded number of times."""

    def __init__(self, page: str):
        self.page = page
        self.unclosed: set[str] = set()  # quotes that do not occur again

    def tag(self, at: int) -> _Tag | int | None:
        """The tag at a ``<``; the end of a comment or declaration; or None if the sign is text."""
        page = self.page
        if m := _PLAIN.match(page, at):
            return _Tag(m[2], bool(m[1]), bool(m[3]), m.end())
        for opens, ends in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">")):
            if page.startswith(opens, at):
                return self._after(ends, at + len(opens))
        closing = page.startswith("</", at)
        m = _NAME.match(page, at + 1 + closing)
        if not m:
            return self._after(">", at + 2) if closing else None
        return self._attributes(m[0], closing, m.end())

    def _after(self, ends: str, at: int) -> int:
        stop = -1 if ends in self.unclosed else self.page.find(ends, at)
        if stop < 0:
            self.unclosed.add(ends)
            return len(self.page)
        return stop + len(ends)

    def _attributes(self, name: str, closing: bool, at: int) -> _Tag | None:
        page, end = self.page, len(self.page)
        hints: list[str] = []
        bare: list[str] = []
        valued = False
        while True:
            gap = _GAP.match(page, at)
            at = gap.end()
            if at >= end or page[at] == ">":
                if bare and not valued and not closing and len(name) == 1 and at < end and not set(bare) <= BARE_WORDS:
                    return None
                return _Tag(name, closing, gap[0].endswith("/"), min(at + 1, end), " ".join(hints))
            m = _ATTRIBUTE.match(page, at)
            at = _SPACES.match(page, m.end()).end()
            if not page.startswith("=", at):
                at = m.end()
                if "<" in m[0] and not valued and not closing and len(name) == 1:
                    return None  # another tag begins
                bare.append(m[0].lower())
                continue
            valued = True
            at = _SPACES.match(page, at + 1).end()
            quote = page[at : at + 1]
            if quote in ('"', "'"):
                stop = -1 if quote in self.unclosed else page.find(quote, at + 1)
                broken = stop < 0
                if broken:
                    self.unclosed.add(quote)
                elif page[stop + 1 : stop + 2] not in ("", " ", "\t", "\n", "\r", "\f", "/", ">"):
                    broken = page.find(">", at, stop) >= 0  # the quote opens the value of a later tag
                if broken:
                    stop = self._after(">", at)
                    return _Tag(name, closing, False, stop, " ".join(hints))
                value, at = page[at + 1 : stop], stop + 1
            else:
                v = _BARE_VALUE.match(page, at)
                value, at = v[0], v.end()
            if m[0].lower() in ("class", "id", "role"):
                hints.append(value)


def _evidence(tag: _Tag) -> int | None:
    """What an element's name and attributes say about it by themselves."""
    if tag.name in FURNITURE_TAGS:
        return FURNITURE
    soft = tag.name == "form"
    story = False
    for token in tag.hints.split():
        words = [w for w in _SPLIT.split(token) if w]
        if not words or words[0] in HAVING_WORDS and len(words) > 1:
            continue
        story = story or not ARTICLE_WORDS.isdisjoint(words)
        if tag.name in PLAIN_TAGS:  # an article that is a reader's comment is the one exception
            soft = soft or (tag.name == "article" and not COMMENT_WORDS.isdisjoint(words))
        elif words[-1] not in PICTURE_WORDS:
            soft = soft or not FURNITURE_WORDS.isdisjoint(words)
    if soft:
        return SOFT
    return ARTICLE if tag.name in ("article", "main") or (story and tag.name not in PLAIN_TAGS) else None


class _Page:
    """Elements that say something about what they hold, as a tree, and the blocks in them."""

    def __init__(self) -> None:
        self.up, self.kind, self.comment, self.holds = [-1], [OUTSIDE], [False], [False]
        self.blocks: list[tuple[str, int, int, int, int]] = []  # text, words, words in links, container, heading

    def enter(self, up: int, kind: int, tag: _Tag) -> int:
        self.up.append(up)
        self.kind.append(kind)
        self.comment.append(not COMMENT_WORDS.isdisjoint(_SPLIT.split(tag.hints)))
        self.holds.append(False)
        if kind == ARTICLE and tag.name in ("article", "main"):
            while up > 0 and not self.holds[up]:
                if self.comment[up]:
                    break
                self.holds[up] = True
                up = self.up[up]
        return len(self.up) - 1

    def resolved(self) -> list[tuple[str, int, int, int, int, float]]:
        """Blocks with the container that counts and its share of the page's words."""
        kind, top = [OUTSIDE], [0]  # strongest kind of a container and those around it, and the outermost soft one
        for c in range(1, len(self.up)):
            own = self.kind[c]
            if self.holds[c] and own in (SOFT, FURNITURE):
                own = OUTSIDE
            above = kind[self.up[c]]
            kind.append(max(own, above))
            top.append(c if own == SOFT and above < SOFT else top[self.up[c]])
        total = sum(b[1] for b in self.blocks if kind[b[3]] != FURNITURE)
        article = sum(b[1] for b in self.blocks if kind[b[3]] == ARTICLE)
        held: dict[int, int] = {}
        for b in self.blocks:
            if kind[b[3]] == SOFT:
                held[top[b[3]]] = held.get(top[b[3]], 0) + b[1]
        # beside an article, and for reader comments, the share says nothing
        share = {c: 0.0 if article or self.comment[c] else n / max(total, 1) for c, n in held.items()}
        return [(*b[:3], kind[b[3]], b[4], share[top[b[3]]] if kind[b[3]] == SOFT else 0.0) for b in self.blocks]


def text_blocks(page: str) -> list[tuple[str, int, int, int, int, float]]:
    """(text, words, words in links, container, heading, share of the container) of the flat blocks of a page, in page order."""
    scanner, found = _Scanner(page), _Page()
    open_tags: list[tuple[str, int, bool]] = []  # element, container, hidden
    named: dict[str, int] = {}  # how many elements of a name are open
    parts: list[str] = []
    linked: list[str] = []
    at, start, end, in_link = 0, 0, len(page), False

    def around() -> tuple[int, bool]:
        return open_tags[-1][1:] if open_tags else (0, False)

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", htmllib.unescape("".join(parts))).strip()
            if text:
                link = htmllib.unescape(" ".join(linked)) if linked else ""
                heading = any(len(t[0]) == 2 and t[0][0] == "h" and t[0][1].isdigit() for t in open_tags[-3:])
                found.blocks.append((text, text.count(" ") + 1, len(link.split()), around()[0], int(heading)))
            parts.clear()
        linked.clear()

    def push(tag: _Tag, kind: int | None, hidden: bool) -> None:
        up, covered = around()
        open_tags.append((tag.name, up if kind is None else found.enter(up, kind, tag), covered or hidden))
        named[tag.name] = named.get(tag.name, 0) + 1

    def pop() -> str:
        name = open_tags.pop()[0]
        named[name] -= 1
        return name

    def close(name: str) -> None:
        """Ends the innermost open element of this name and all in it; a stray end tag, and one of p beyond its block, do nothing."""
        if named.get(name) and (name != "p" or open_tags[-1][0] == "p"):
            while pop() != name:
                pass

    while at < end:
        less = page.find("<", at)
        tag = scanner.tag(less) if less >= 0 else end
        if tag is None:
            at = less + 1
            continue
        chunk = page[start : less if less >= 0 else end]
        if chunk and not around()[1]:
            parts.append(chunk)
            if in_link:
                linked.append(chunk)
        start = at = tag if isinstance(tag, int) else tag.stop
        if isinstance(tag, int):
            continue
        name = tag.name
        if name == "a":
            in_link = not tag.closing
            continue
        if name not in BLOCK_TAGS and name not in HIDDEN_TAGS:
            if not tag.closing and tag.hints and name not in VOID_TAGS and _evidence(tag) == SOFT:
                flush()
                push(tag, SOFT, False)
            elif tag.closing and named.get(name):
                flush()
                close(name)
            continue
        flush()
        if tag.closing:
            close(name)
            in_link = False
        elif name not in VOID_TAGS and not tag.empty:
            if name in CLOSES_P and open_tags and open_tags[-1][0] == "p":
                pop()
            if name in ("li", "dt", "dd", "td", "th", "tr", "option") and open_tags and open_tags[-1][0] == name:
                pop()
            kind = _evidence(tag)
            # a header inside an article holds its headline; other furniture stays furniture inside it
            if name == "header" and not tag.hints and _inside_article(found, around()[0]):
                kind = ARTICLE
            push(tag, kind, name in HIDDEN_TAGS)
            if name in RAW_TAGS:
                stop = _RAW_END[name].search(page, at)
                start = at = stop.end() if stop else end
                pop()
    if start < end and not around()[1] and at >= end:
        parts.append(page[start:end])
    flush()
    return found.resolved()


def _inside_article(found: _Page, c: int) -> bool:
    while c > 0:
        if found.kind[c] != OUTSIDE:
            return found.kind[c] == ARTICLE
        c = found.up[c]
    return False


def block_features(blocks: list[tuple[str, int, int, int, int, float]]) -> np.ndarray:
    words = np.asarray([b[1] for b in blocks], float)
    links = np.minimum(1.0, np.asarray([b[2] for b in blocks], float) / np.maximum(words, 1))
    before, after = (lambda v: np.concatenate([[0.0], v[:-1]])), (lambda v: np.concatenate([v[1:], [0.0]]))
    return np.column_stack([words, links, before(words), before(links), after(words), after(links), *([b[k] for b in blocks] for k in (3, 4, 5))])


def extract_text(page: str, tree: Tree) -> str:
    blocks = text_blocks(page)
    if not blocks:
        return ""
    main = tree.predict(block_features(blocks)) >= 0.5
    return " ".join(b[0] for b, m in zip(blocks, main, strict=True) if m)


def extract_pages(pages: DataFrame, html: str = "html", keys: tuple[str, ...] = ("page_id", "url"), carry: list[str] | None = None) -> DataFrame:
    """``keys`` and ``carry`` of every page with its main ``text`` and ``n_chars``."""
    tree = trained_tree()
    kept = [*keys, *[c for c in (carry or []) if c in others(pages, (*RESULT, *keys))]]
    rows = pages.select(*[quoted(c).alias(f"__c{k}") for k, c in enumerate(kept)], F.coalesce(quoted(html).cast("string"), F.lit("")).alias("__html"))
    types = [ids_field(rows, f"__c{k}") for k in range(len(kept))]
    schema = T.StructType([*[T.StructField(c, pages.schema[c].dataType) for c in kept], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__html", 1000, 8 << 20):
            texts = [extract_text(page, tree) for page in batch.column("__html").to_pylist()]
            columns = [batch.column(k).cast(t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return rows.mapInArrow(extract, schema)
