"""Main text of HTML pages by minimum-cut labelling.

A page becomes a sequence of text blocks. Each block has a cost from a classifier, a sum of log-odds: elements and roles that
hold no article (nav, footer, ...), names of class and id, phrases of notices, link density, length, headings, and whether the
block stands outside of an article element on a page that has one. In favour of content it is a capacity from the source,
against it a capacity to the sink. Blocks that follow each other, and blocks that are near in the element tree, are tied by
smoothness edges, weaker where the tree's evidence changes. The minimum cut labels blocks: what stays with the source is
content, so that a block's neighbours can overrule its own sign both ways (a link between paragraphs, plain text in a menu).
Blocks whose terminal capacity exceeds all that ties them are settled first (their edges are saturated in any maximum flow),
the rest by augmenting paths.

Weights are fixed parameters, not fitted: pages carry no labels. No evidence is absolute: the strongest cue is ``STRONG``, and
what speaks for content can reach 8. A name counts in full if all its words are known, and as a hint if it has other words
(``social-history``).

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined in
page order by two line feeds. Scripts, styles, comments, forms and markup are no text. Nothing else is dropped or cut.

Defined cases: null or empty html gives an empty text; unclosed elements end with their parent or the page; an unclosed
tag, comment or script reaches to the page's end; pages of bare text are one block. Rows are treated one by one, so
repeated rows and ties need no rule. Extra columns are not read. Everything happens inside a row: no shuffle.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed lists of HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NO_TEXT = frozenset("script style head title template noscript textarea select option button svg math iframe object audio video canvas map datalist".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table tbody thead tfoot article section div main body nav aside header footer form blockquote".split())
#: Words of names (class, id) and roles that speak against content, for it, or neither way.
BOILER_TAGS = frozenset("nav footer aside form menu dialog".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner alert breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright discussion disqus disclaimer dropdown footer gdpr header login masthead menu menus modal "
    "nav navbar navigation navi newsletter notice notices overlay pager pagination paging popup promo promoted promotion related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
HEADER_WORDS = frozenset("header masthead banner".split())
CONTENT_WORDS = frozenset("article body content entry main post story text".split())
NEUTRAL_WORDS = frozenset("area bar block bottom box button buttons container footnote form global icons inner item left link links list message page panel policy primary right secondary section site slot top unit user wrap wrapper".split())
PHRASES = re.compile(r"all rights reserved|©|\bcopyright\b|\bprivacy policy\b|\bterms of (?:use|service)\b|\b(?:accept|use|uses) cookies\b|\bsubscribe (?:to|now)\b|\bnewsletter\b|\bsign (?:up|in) \b|\blog in\b|^advertisement\b|\bsponsored (?:by|content|post)\b|\bfollow us\b|\bshare this\b|\brelated (?:posts|articles|stories)\b|\bleave a (?:reply|comment)\b", re.I)
#: Words that a text with one of the phrases has.
KEYS = ("reserved", "©", "copyright", "privacy policy", "terms of", "cookies", "subscribe", "newsletter", "sign ", "log in", "advertisement", "sponsored", "follow us", "share this", "related ", "leave a ")
#: Costs of the classifier, in nats of log-odds for content. PHRASE fades in blocks of over 120 characters, and is nothing beyond 1,200.
STRONG, HINT, ARTICLE, GOOD_WORD, PLAIN, PER_CHAR, MOST_LENGTH, LINKS, HEADING, TITLE, OUTSIDE, PHRASE = -9.0, -3.0, 4.0, 2.0, 0.5, 1 / 120, 3.0, -4.0, 0.4, 4.0, -4.0, -4.0
LEAST_ARTICLE = 200
#: Capacities of smoothness edges: neighbours in the page, with the same parent, or with parents that share theirs; CHANGE: their
#: part where one block's elements speak against content and the other's don't.
ADJACENT, SIBLINGS, COUSINS, CHANGE = 0.8, 1.2, 0.6, 0.25

_TOKEN = re.compile(r"<!--(?:.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noscript", "svg", "template")}
_WORD = re.compile(r"[a-z]+")


@dataclass
class Element:
    tag: str
    parent: Element | None
    against: float  # the strongest evidence of the element and those around it, 0 or less
    content: int
    silent: bool


@dataclass
class Block:
    text: str
    element: Element
    cost: float


def _named(value: str, inside: bool) -> tuple[float, bool]:
    """What names say: evidence against content, and whether one speaks for it."""
    against, good = 0.0, False
    for name in value.split():
        words = _WORD.findall(name)
        bad = [w for w in words if w in BOILER_WORDS and not (inside and w in HEADER_WORDS)]  # an article's own head is part of it
        if bad:
            known = all(w in BOILER_WORDS or w in CONTENT_WORDS or w in NEUTRAL_WORDS for w in words)
            against = min(against, STRONG if known else HINT)
        elif not CONTENT_WORDS.isdisjoint(words):
            good = True
    return against, good


def _open(tag: str, attrs: str, up: Element) -> Element:
    against, content, silent = up.against, up.content, up.silent or tag in NO_TEXT
    if tag in ("article", "main"):
        content = max(content, 2)
    if tag in BOILER_TAGS or tag == "header" and up.content < 2:
        against = STRONG
    if attrs:
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), (a or b or c).lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in BOILER_ROLES:
                against = STRONG
            elif name in ("class", "id"):
                bad, good = _named(value, up.content == 2)
                if tag not in ("html", "body", "article", "main"):
                    against = min(against, bad)
                if good and not bad:
                    content = max(content, 1)
    return Element(tag, up, against, content, silent)


def blocks(html: str) -> list[Block]:
    root = here = Element("", None, 0.0, 0, False)
    out: list[Block] = []
    parts: list[str] = []
    linked: list[int] = [0, 0]  # characters in links, in all

    def flush() -> None:
        nonlocal parts
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text and not owner.silent:
                out.append(Block(text, owner, _cost(text, owner, linked[0] / max(1, linked[1]))))
            parts, linked[:] = [], [0, 0]

    owner, in_link, pos, n = root, 0, 0, len(html)
    while pos < n:
        m = _TOKEN.search(html, pos)
        end = m.start() if m else n
        if end > pos and not here.silent:
            if not parts:
                owner = here
                while owner.tag in INLINE and owner.parent:
                    owner = owner.parent
            parts.append(html[pos:end])
            linked[1] += end - pos
            linked[0] += end - pos if in_link else 0
        if not m:
            break
        pos = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if tag not in INLINE and tag != "br":
            flush()
        if m[1]:
            at = here
            while at.parent and at.tag != tag:
                if tag in INLINE and at.tag in SCOPES:
                    at = root
                    break
                at = at.parent
            if at.parent:
                while here is not at.parent:
                    in_link -= here.tag == "a"
                    here = here.parent
        elif tag == "br":
            if parts:
                parts.append(" ")
        elif tag not in VOID:
            if not m[4]:
                break
            if tag not in INLINE and tag not in NO_TEXT:
                at = here
                shut = {"p", "h1", "h2", "h3", "h4", "h5", "h6"} if tag not in CLOSES else CLOSES[tag] | {"p"}
                while at.parent and at.tag not in SCOPES:
                    if at.tag in shut:
                        while here is not at.parent:
                            in_link -= here.tag == "a"
                            here = here.parent
                    at = at.parent
            if m[3].endswith("/") and tag in ("svg", "path"):
                continue
            here = _open(tag, m[3], here)
            in_link += tag == "a"
            if tag in _RAW:
                close = _RAW[tag].search(html, pos)
                pos = close.start() if close else n
    flush()
    if sum(len(b.text) for b in out if b.element.content == 2 and b.cost > 0) >= LEAST_ARTICLE:
        for b in out:
            if b.element.content < 2:
                b.cost += OUTSIDE
    return out


def _cost(text: str, e: Element, links: float) -> float:
    """Positive in favour of content."""
    score = PLAIN + min(MOST_LENGTH, len(text) * PER_CHAR) + LINKS * links + e.against + (0.0, GOOD_WORD, ARTICLE)[e.content]
    if len(text) <= 1200:
        low = text.lower()
        if any(k in low for k in KEYS) and PHRASES.search(low):
            score += PHRASE * min(1.0, 120 / len(text))
    return score + (TITLE if e.tag == "h1" else HEADING if e.tag in ("h2", "h3") else 0.0)


def smoothness(found: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours in the page, stronger the nearer they are in the tree, and between a parent's next blocks."""
    edges, last = [], {}
    tie = lambda i, j, w: edges.append((i, j, w if found[i].element.against == found[j].element.against else w * CHANGE))
    for i, b in enumerate(found):
        up = b.element.parent
        if i:
            a = found[i - 1].element
            near = SIBLINGS if a is b.element or a.parent is up else COUSINS if a.parent and up and a.parent.parent is up.parent else 0.0
            tie(i - 1, i, ADJACENT + near)
        j = last.get(id(up))
        if j is not None and j < i - 1:
            tie(j, i, SIBLINGS)
        last[id(up)] = i
    return edges


def min_cut(cost: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut; ``cost``: source capacity if positive, else minus sink capacity."""
    n = len(cost)
    tie: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        tie[i][j] = tie[i].get(j, 0.0) + w
        tie[j][i] = tie[j].get(i, 0.0) + w
    left, label = list(cost), [None] * n
    todo = deque(range(n))
    while todo:  # settled nodes give their neighbours the capacity of the edge between
        i = todo.popleft()
        if label[i] is None and abs(left[i]) >= sum(tie[i].values()):
            label[i] = left[i] > 0
            for j, w in tie[i].items():
                left[j] += w if label[i] else -w
                del tie[j][i]
                todo.append(j)
            tie[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    source = [max(0.0, x) for x in left]
    sink = [max(0.0, -x) for x in left]
    while rest:
        came: dict[int, int | None] = {i: None for i in rest if source[i] > 1e-12}
        queue, end = deque(came), None
        while queue and end is None:
            i = queue.popleft()
            if sink[i] > 1e-12:
                end = i
                break
            for j, w in tie[i].items():
                if w > 1e-12 and j not in came:
                    came[j] = i
                    queue.append(j)
        if end is None:
            for i in rest:
                label[i] = i in came
            break
        flow, i = sink[end], end
        while came[i] is not None:
            flow, i = min(flow, tie[came[i]][i]), came[i]
        flow = min(flow, source[i])
        source[i] -= flow
        sink[end] -= flow
        i = end
        while came[i] is not None:
            tie[came[i]][i] -= flow
            tie[i][came[i]] += flow
            i = came[i]
    return [bool(x) for x in label]


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    keep = min_cut([b.cost for b in found], smoothness(found))
    return "\n\n".join(b.text for b, k in zip(found, keep) if k)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x) for x in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
