"""Main text of web pages by tree scoring.

Each page becomes a small element tree.  Boilerplate elements (by tag, role or
class word) are left out, unless one with a class word or a form wraps the article: it
holds ``main`` or most of the page's unlinked text (``DOMINANT``).  Every paragraph gets points for its length and commas and
passes them to its ``LEVELS`` nearest ancestors, fewer the farther up; an ancestor's points are
discounted by the share of its text that is link text.  The best container is
kept, with those of its siblings that look like more of the article (headings, lists, tables and the
like among them or beside it, whatever their points), and its text blocks are written out in page order.
Work and memory grow with the page's length, however deep its elements are nested.

Pages are independent rows: no shuffle, one page in memory at a time beyond its
Arrow batch.

Defined results: null or empty html gives the empty text; unclosed or stray tags and
cut-off pages are read as browsers do; a page without any paragraph gives the
text outside boilerplate; repeated rows each get a row; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements whose text never belongs to an article
SKIP = frozenset("script style noscript template iframe canvas button select textarea "
                 "nav footer aside menu dialog head title audio video map".split())
BLOCK = frozenset("address article blockquote body dd details div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th "
                  "thead tr ul aside center menu dialog caption".split())
#: start tags that end an open element of the same group
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table article section div body html main td th blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
#: words of class and id names that mark boilerplate
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie "
                  "cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login menu nav "
                  "navbar navigation breadcrumb breadcrumbs sidebar footer masthead header topbar toolbar share "
                  "sharing social related recommended comment comments reply replies disqus respond widget "
                  "pagination pager skip".split())
DOMINANT = 0.75  # share of the page's unlinked text that no boilerplate holds
ENOUGH = 200     # characters of unlinked text of an article that stands elsewhere
LEVELS = 32
SEMANTIC = frozenset(["article", "main"])
#: elements of an article that have few points of their own
PARTS = frozenset("h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure address details".split())
SCORED = frozenset("p pre td blockquote div section article main li dd h2 h3 body".split())


class Node:
    __slots__ = ("tag", "up", "kids", "skip", "marked", "inside", "points", "text", "linked")

    def __init__(self, tag, up, skip):
        self.tag, self.up, self.skip = tag, up, skip
        self.inside = tag in SEMANTIC or up is not None and up.inside  # of an article
        self.marked = False  # boilerplate by its class or id words, or a form: see _unmark
        self.kids: list = []
        self.points = 0.0
        self.text = self.linked = 0  # characters, and those inside links


def _boilerplate(tag, attrs, up) -> tuple[bool, bool]:
    """(surely, by its marks)"""
    if up.skip or tag in SKIP:
        return True, False
    if tag in ("html", "body", *SEMANTIC):
        return False, False
    inside = up.inside
    if tag == "header" and not inside:
        return True, False
    a = dict(attrs)
    role = (a.get("role") or "").lower()
    if "hidden" in a or a.get("aria-hidden") == "true" or role in ROLES:
        return True, False
    if re.search(r"display\s*:\s*none", a.get("style") or ""):
        return True, False
    if tag == "form" or role == "form":
        return False, True
    marks = set(re.split(r"[^a-z0-9]+", f"{a.get('class') or ''} {a.get('id') or ''}".lower())) & MARKS
    return False, bool(marks - {"header"} if inside else marks)


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None, False)
        self.open: dict[str, int] = {}  # open elements by tag

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):  # one of each; their boilerplate marks say nothing
            return
        if tag in BLOCK:
            self._end({"p"}, SCOPE)
        if tag in CLOSES:
            self._end(CLOSES[tag], SCOPE)
        skip, marked = _boilerplate(tag, attrs, self.at)
        node = Node(tag, self.at, skip)
        node.marked = marked
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in ("html", "body"):
            self._end({tag}, frozenset(["html"]) if tag in BLOCK else frozenset(["html", "td", "th", "article", "body"]))

    def _end(self, tags, scope):
        if not any(self.open.get(t) for t in tags):
            return
        node = self.at
        while node.up is not None:
            if node.tag in tags:
                while self.at is not node.up:
                    self.open[self.at.tag] -= 1
                    self.at = self.at.up
                return
            if node.tag in scope:
                return
            node = node.up

    def handle_data(self, data):
        if not self.at.skip:
            self.at.kids.append(data)


def _walk(node):
    """All nodes outside boilerplate, parents first."""
    todo = [node]
    while todo:
        node = todo.pop()
        yield node
        todo += [k for k in node.kids if isinstance(k, Node) and not k.skip]


def _unmark(root) -> None:
    """Leaves out marked elements, but not those that wrap the article: those that hold
    ``main``, or ``DOMINANT`` of the page's unlinked text (half of it with an article inside)
    while no other article stands outside."""
    nodes = list(_walk(root))
    if not any(n.marked for n in nodes):
        return
    text, has_main, inner = {}, {}, {}  # by id: unlinked text, main inside, text of articles inside
    linked, under = {}, {}  # inside a link, inside a marked element
    for n in nodes:
        up = n.up
        linked[id(n)] = n.tag == "a" or up is not None and linked[id(up)]
        under[id(n)] = n.marked or up is not None and under[id(up)]
    clear = set()  # articles outside marked elements
    for n in reversed(nodes):
        kids = [k for k in n.kids if isinstance(k, Node) and not k.skip]
        own = 0 if linked[id(n)] else sum(len(k.strip()) for k in n.kids if isinstance(k, str))
        text[id(n)] = own + sum(text[id(k)] for k in kids)
        has_main[id(n)] = n.tag == "main" or any(has_main[id(k)] for k in kids)
        inner[id(n)] = n.tag in SEMANTIC or any(inner[id(k)] for k in kids)
        if n.tag in SEMANTIC and not under[id(n)] and text[id(n)] >= ENOUGH:
            clear.add(id(n))
    whole = text[id(root)]
    above = {}  # of those, around each node or itself
    for n in nodes:
        above[id(n)] = (above[id(n.up)] if n.up is not None else 0) + (id(n) in clear)
        if not n.marked or has_main[id(n)]:
            continue
        elsewhere = above[id(n)] < len(clear)
        share = text[id(n)] / whole if whole else 0.0
        n.skip = elsewhere or share < (0.5 if inner[id(n)] else DOMINANT)


def blocks(node) -> list[str]:
    """Text blocks under ``node``, white space inside each folded."""
    out, run = [], []

    def flush():
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    todo = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag in ("br", "wbr"):
            run.append(" " if x.tag == "br" else "")
        elif not x.skip:
            if x.tag in BLOCK:
                flush()
                todo.append(None)
            todo += reversed(x.kids)
    flush()
    return out


def _own(node) -> str:
    """Text of a node and of its inline descendants."""
    out, todo = [], [*reversed(node.kids)]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.skip and x.tag not in BLOCK:
            if x.tag == "br":
                out.append(" ")
            todo += reversed(x.kids)
    return " ".join("".join(out).split())


def _score(root) -> list:
    nodes = list(_walk(root))
    for node in reversed(nodes):  # children first
        linked = node.tag == "a"
        for k in node.kids:
            if isinstance(k, str):
                n = len(k.strip())
                node.text += n
                node.linked += n * linked
            elif not k.skip:
                node.text += k.text
                node.linked += k.text if linked else k.linked
    for node in nodes:
        if node.tag in SEMANTIC:
            node.points += 25
        if node.tag not in SCORED:
            continue
        own = _own(node)
        if not own:
            continue
        points = 1 + own.count(",") + min(len(own) / 100, 3)
        up, level = node.up, 0
        if node.tag not in ("p", "pre", "li", "h2", "h3", "dd"):  # bare text: its element is the container
            node.points += points
            level = 1
        while up is not None and level < LEVELS:
            up.points += points / (1, 2, 3 * level)[min(level, 2)]
            up, level = up.up, level + 1
    for node in nodes:
        node.points *= 1 - (node.linked / node.text if node.text else 0)
    return nodes


def main_text(html: str | None) -> str:
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    _unmark(tree.root)
    nodes = _score(tree.root)
    best = max((n for n in nodes if n.text), key=lambda n: n.points, default=None)
    if best is None or best.points <= 0:
        return "\n\n".join(blocks(tree.root))
    up = best
    while up is not None:  # the article around the best part of it
        if up.tag in SEMANTIC:
            best = up
            break
        up = up.up
    if best.up is None:
        return "\n\n".join(blocks(best))
    kept, first, last = {}, None, None
    for n, k in enumerate(best.up.kids):
        if isinstance(k, str):
            continue
        density = k.linked / k.text if k.text else 0.0
        if k is best or not k.skip and k.text and (
                k.points >= max(10, best.points / 5) and density < 0.33 or k.tag == "p" and density < 0.25 and (
                    k.text > 80 or density == 0 and re.search(r"[.!?]\s*$", _own(k)))):
            kept[n] = k
            first, last = n if first is None else first, n
    for n, k in enumerate(best.up.kids):  # the article's headings, lists, tables
        if (isinstance(k, Node) and n not in kept and not k.skip and k.tag in PARTS and k.linked < 0.33 * k.text
                and (best.up.up is not None or first < n < last)):
            kept[n] = k
    return "\n\n".join(t for n in sorted(kept) for t in blocks(kept[n]))


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(batches):
    for batch in batches:
        text = [main_text(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1).cast(pa.string()), pa.array(text, pa.string()),
             pa.array([len(t) for t in text], pa.int64())], schema=_OUT)


def main_texts(pages: DataFrame) -> DataFrame:
    """One row a page: page_id, url, text, n_chars."""
    return (pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
            .mapInArrow(_extract, "page_id long, url string, text string, n_chars long"))
