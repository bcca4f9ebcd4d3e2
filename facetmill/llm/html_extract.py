"""Main text of web pages by minimum cut.

A page becomes a row of text blocks (runs of text between block-level tags). A linear classifier
over a block's ancestors, link share and length gives the cost of calling it content and the cost
of calling it boilerplate; these are the capacities to the two terminals. Neighbouring blocks, and
the next block under the same parent, are tied by smoothness edges that weaken with their distance
in the tree. The maximum flow's minimum cut labels all blocks of the page at once.

No labelled pages exist to train the classifier, so its weights are fixed values.

Defined cases: null or empty html gives the empty text and 0 characters; markup that is never closed
or never opened is read as browsers do, roughly; pages of any length are read whole; null ids,
repeated rows and extra columns are no special cases.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, table
from .decontaminate import slices

# HTML element classes.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("head title script style noscript template svg math iframe object canvas audio video select textarea button datalist".split())
CLOSED_BY = {"p": BLOCK_TAGS - {"option", "body", "html", "head", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}
SCOPES = frozenset("table ul ol dl body article section div form td".split())
PLAIN_TAGS = frozenset("nav footer aside form menu dialog search fieldset".split())
PLAIN_ROLES = frozenset("navigation contentinfo complementary search dialog alertdialog alert banner form menu menubar toolbar".split())
PLAIN_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising alert aside banner breadcrumb breadcrumbs byline comment comments commentlist consent "
    "cookie cookies copyright disclaimer discussion disqus dropdown feedback footer form gdpr legal links login masthead menu menus modal nav navbar navigation "
    "newsletter notice notices notification overlay pager pagination paywall popup privacy promo promoted promotion recommend recommended recommendations related replies reply respond "
    "responses search share sharing sidebar sidenav signin signup skip social sponsor sponsored sponsors subscribe subscription tagcloud teaser toast toolbar topbar widget widgets".split()
)
#: Of those, the words that count even on an article or main element itself.
ARTICLE_WORDS = frozenset("ad ads advert advertisement comment comments promo promoted related recommended reply sponsored teaser".split())
#: A class or id with one of these speaks of the layout of what it wraps ("has-sidebar").
LAYOUT_WORDS = frozenset("has no with without layout".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEAD_WORDS = frozenset("header head heading masthead".split())
CONTENT_WORDS = frozenset("article content entry main post story text".split())
# Weights of the classifier, in log odds of boilerplate; integers are thousandths.
W_PLAIN, W_PLAIN_WORD, W_HEADER, W_HEADING_IN_HEADER, W_HIDDEN = 9000, 6000, 7000, -500, 12000
W_ARTICLE, W_CONTENT_WORD, W_BASE, W_PROSE_TAG, W_HEADING, W_LIST = -2500, -1000, -600, -900, -500, 300
W_LINKS, W_PER_WORD, W_MOST_WORDS, W_SIGN = 3500, -60, -1800, 2500
W_SMOOTH_NEXT, W_SMOOTH_PARENT = 500, 900
#: Words of a block of running text.
PROSE_WORDS = 12


class Element:
    __slots__ = ("tag", "parent", "depth", "plain", "header", "content", "article", "hidden", "loose", "half", "articles", "prose", "linked", "root", "block", "scope", "marked")

    def __init__(self, tag: str, parent: Element | None, attrs: list[tuple[str, str | None]]):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        # nearest of its kind, itself included; a page may nest its elements without end
        self.root = parent.root if parent else self
        self.block = self if tag in BLOCK_TAGS or not parent else parent.block
        self.scope = self if tag in CLOSED_BY or tag in SCOPES or not parent else parent.scope
        self.header = parent.header if parent else False
        self.articles = self.prose = self.linked = 0
        self.content, self.article, self.hidden = (parent.content, parent.article, parent.hidden) if parent else (False, False, False)
        words, marks, role = set(), set(), ""
        for k, v in attrs:
            if k in ("class", "id") and v and tag not in ("html", "body"):
                for name in v.split():
                    new = set(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))
                    words |= new
                    # the id of a heading or of an article's section is an anchor made from its title
                    anchor = k == "id" and (tag in HEADINGS or tag == "section" and self.article and not new <= ARTICLE_WORDS)
                    if not anchor and not new & LAYOUT_WORDS:
                        marks |= new
            elif k == "role":
                role = (v or "").strip().lower()
            elif k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v.lower()):
                self.hidden = True
        own = tag in ("article", "main") or role in ("main", "article")
        strict = tag in PLAIN_TAGS and tag != "form" or role in PLAIN_ROLES and role != "form" and not (role == "banner" and tag == "header")
        strong = bool(marks & ARTICLE_WORDS)
        weak = tag == "form" or role == "form" or not own and bool(marks & PLAIN_WORDS)
        self.plain = W_PLAIN if strict or strong else W_PLAIN_WORD if weak else 0
        self.loose, self.half = not strict, not strong
        self.header = self.header or tag == "header" or role == "banner" or bool(marks & HEAD_WORDS) and not own and tag not in HEADINGS
        if own and not self.plain:
            self.article, self.articles = True, 1
        self.marked = self if self.plain else parent.marked if parent else None
        self.content = self.content or bool(words & CONTENT_WORDS)


class Blocks(HTMLParser):
    """The text blocks of a page, with the element that each lies in and its share of link text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = Element("", None, [])
        self.elements, self.open = [self.top], Counter()
        self.silent = self.links = 0
        self.parts: list[str] = []
        self.n_link = 0
        self.blocks: list[tuple[str, Element, float]] = []

    def _flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                at = self.top.block
                self.blocks.append((text, at, min(1.0, self.n_link / len(text))))
                linked = min(len(text), self.n_link)
                at.linked += linked
                at.prose += len(text) - linked
            self.parts, self.n_link = [], 0

    def _pop(self) -> None:
        tag = self.top.tag
        if tag in SILENT_TAGS:
            self.silent -= 1
        elif tag == "a":
            self.links -= 1
        if tag in BLOCK_TAGS:
            self._flush()
        self.open[tag] -= 1
        self.top = self.top.parent

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK_TAGS:
            self._flush()
            if tag == "body" and self.silent:  # a head that was not closed
                while self.top.parent and self.silent:
                    self._pop()
            at = self.top.scope
            if tag in CLOSED_BY.get(at.tag, ()):
                while self.top is not at:
                    self._pop()
                self._pop()
        elif tag == "br":
            self.parts.append(" ")
        if tag not in VOID_TAGS:
            self.top = Element(tag, self.top, attrs)
            self.elements.append(self.top)
            self.open[tag] += 1
            self.silent += tag in SILENT_TAGS
            self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS and tag in ("script", "svg", "math"):
            self._pop()

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self._flush()
        if not self.open[tag]:
            return
        at = self.top
        while at.parent and at.tag != tag:
            if at.tag in BLOCK_TAGS and tag not in BLOCK_TAGS:  # an inline end tag closes nothing beyond its block
                return
            at = at.parent
        if at.parent:
            while self.top is not at:
                self._pop()
            self._pop()

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.n_link += len(data)

    def close(self):
        super().close()
        self._flush()
        for at in reversed(self.elements[1:]):  # what lies inside counts for all around it
            at.parent.articles += at.articles
            at.parent.prose += at.prose
            at.parent.linked += at.linked
        return self.blocks


def plain_weight(at: Element) -> int:
    """The heaviest mark of boilerplate on an element and its ancestors.

    A keyword or form marks nothing if it wraps the page: all its articles, or, where there are none, most of its prose.
    """
    marked, at, own = [], at.root, at.marked
    while own:
        marked.append(own)
        own = own.parent.marked if own.parent else None
    wraps = lambda e: e.loose and e.prose > e.linked and (e.articles == at.articles if at.articles else e.half and 2 * e.prose > at.prose)
    return max((e.plain for e in marked if not wraps(e)), default=0)


def is_prose(text: str, at: Element, links: float) -> bool:
    """A block that reads as running text where nothing marks it as boilerplate."""
    return links < 0.5 and text.count(" ") + 1 >= PROSE_WORDS and not at.header and not at.hidden and not plain_weight(at)


def unmark_wrappers(blocks: list[tuple[str, Element, float]]) -> None:
    """Where keywords mark all running text of a page, the outermost marked element that holds most of it wraps
    the article ("post comments-open"), so its keyword says nothing; until some text is unmarked."""
    while blocks and not any(is_prose(*b) for b in blocks):
        root, most = blocks[0][1].root, None
        for _, at, _ in blocks:
            own = at.marked
            while own:
                if own.plain and own.loose and 2 * own.prose > root.prose and (most is None or own.depth < most.depth):
                    most = own
                own = own.parent.marked if own.parent else None
        if most is None:
            return
        most.plain = 0


def block_cost(text: str, at: Element, links: float) -> int:
    """Log odds of boilerplate, in thousandths."""
    heading, plain = at.tag in HEADINGS, plain_weight(at)
    cost = W_BASE + int(W_LINKS * links) + max(W_MOST_WORDS, W_PER_WORD * (text.count(" ") + 1))
    cost += plain + W_HIDDEN * at.hidden + W_ARTICLE * at.article + W_CONTENT_WORD * at.content
    if at.header:
        cost += W_HEADING_IN_HEADER if heading and (at.article or at.content) and not plain else W_HEADER
    if at.tag in ("p", "pre", "blockquote"):
        cost += W_PROSE_TAG
    elif heading:
        cost += W_HEADING
    elif at.tag == "li":
        cost += W_LIST
    if text[0] == "©" or text[:9].lower() == "copyright":
        cost += W_SIGN
    return cost


def tree_distance(a: Element, b: Element) -> int:
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def min_cut(costs: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for nodes on the content side of a minimum cut (augmenting along shortest paths, in phases).

    A node with cost > 0 hangs on the boilerplate terminal, one with cost < 0 on the content terminal.
    """
    n = len(costs)
    left, right = [max(0, -c) for c in costs], [max(0, c) for c in costs]
    graph: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    for a, b, w in edges:
        graph[a].append(len(to))
        to.append(b)
        room.append(w)
        graph[b].append(len(to))
        to.append(a)
        room.append(w)
    while True:
        level = [0 if left[i] else -1 for i in range(n)]
        queue = [i for i in range(n) if left[i]]
        for a in queue:
            for e in graph[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if not any(right[i] for i in queue):
            return [x >= 0 for x in level]
        turn = [0] * n
        for start in [i for i in queue if level[i] == 0]:
            path: list[int] = []  # edges from start
            a = start
            while left[start]:
                if right[a]:
                    flow = min(left[start], right[a], *(room[e] for e in path)) if path else min(left[start], right[a])
                    left[start] -= flow
                    right[a] -= flow
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    path, a = [], start
                    continue
                while turn[a] < len(graph[a]):
                    e = graph[a][turn[a]]
                    if room[e] and level[to[e]] == level[a] + 1:
                        break
                    turn[a] += 1
                if turn[a] < len(graph[a]):
                    path.append(e)
                    a = to[e]
                elif path:
                    a = to[path.pop() ^ 1]
                    turn[a] += 1
                else:
                    break


def main_text(html: str | None) -> str:
    """The content blocks of a page in page order, joined by an empty line."""
    if not html:
        return ""
    parser = Blocks()
    parser.feed(html)
    blocks = parser.close()
    unmark_wrappers(blocks)
    edges, latest = [], {}
    for i, (_, at, _) in enumerate(blocks):
        if i:
            edges.append((i - 1, i, W_SMOOTH_NEXT // (1 + tree_distance(blocks[i - 1][1], at))))
        if (k := id(at.parent)) in latest:
            edges.append((latest[k], i, W_SMOOTH_PARENT))
        latest[k] = i
    content = min_cut([block_cost(*b) for b in blocks], [e for e in edges if e[2]])
    return "\n\n".join(b[0] for b, keep in zip(blocks, content) if keep)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "html", 4_000_000)):
            text = pa.array([main_text(h) for h in batch.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), text], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    out = rows.mapInArrow(lean(run), "page_id long, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op2_html_extract(spark, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
