"""Main text of HTML pages by composite text density.

The page is parsed to a tree. Parts that are no article by their tag or role
(menus, headers, footers, sidebars, notices, forms and their labels, dialogs, scripts, styles, what a
canvas or a player shows in its stead) are cut. A class or id marks a part as no
article only if one of its names says nothing else (``cookie-banner``, ``comment-list``,
not ``search-results-page``), and only if the part does not hold most of the
page's text outside links (nearly all of it, for names of one such word and for reader comments). For every node left, the composite density is
its characters for each tag, lowered by the share of link characters and link
tags; a node's sum is the total over its children, those inside a paragraph left
out. The node of largest sum is the core, and the smallest density on the path from
the core to the body is the threshold. The text is the smallest subtree below the
body that holds the core and whatever around it reaches the threshold (or is a
paragraph, heading or the like right beside it), with the body's other children
that reach it. Inside, groups of links below the threshold are menus and go.
Densities decide so on every page, whether it has an ``article`` or not.

Defined cases: null and empty html give an empty text; broken markup is read
leniently (unclosed tags, comments and scripts end as browsers end them, a quote
that never closes is a letter); nesting beyond ``DEPTH`` is read as siblings, as
browsers do; a page with nothing but menus gives an empty text; equal sums go to
the node that begins first; repeated rows give repeated rows; other columns pass
through, one named as the output is replaced; no rows give no rows. Time and memory
are linear in a page's length.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg object".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CUT_TAGS = frozenset("head script style noscript template iframe svg object embed canvas audio video nav aside footer button input select textarea option label dialog menu title".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words of a class or id that mark what is no article: menus; headers and footers; sidebars; notices; adverts; forms; comments.
CUT_WORDS = frozenset(
    "menu menus nav navbar navigation breadcrumb breadcrumbs toolbar topbar masthead footer sidebar sidebars cookie cookies consent gdpr notice notices popup modal overlay banner ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion newsletter subscribe subscription signup login search comment comments commentlist disqus respond replies".split()
)
#: Words that may stand beside those in one name without saying anything else.
PLAIN_WORDS = frozenset(
    "a an the of x site main page top left right bottom side bar box block list area section wrapper wrap container content widget panel post article entry blog user reader visitor form link links item inner outer global primary secondary header col column group holder unit slot text center mobile desktop sticky fixed app root js el block is has".split()
)
#: A part that holds more than this of the page's text is not cut for its class: for a name of several words; for one word, and for comments.
HALF, NEARLY_ALL = 0.5, 0.95
#: Blocks that hold text themselves.
TEXTS = frozenset("blockquote dl h1 h2 h3 h4 h5 h6 ol p pre table ul".split())
#: Whole class names and ids of a page's header.
HEADERS = frozenset("header site-header page-header top-header".split())
#: An end tag that is missing before such a start tag.
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
DEPTH = 512
#: So many links, which are most of the text, are a menu.
LINKS, LINKED = 3, 0.6
NAME = re.compile(r"[A-Za-z][^\s/>]*")
STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I) for tag in RAW}
ZEROS, LONG = re.compile("(&#[xX]?)0+(?=[0-9a-fA-F])"), re.compile("&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")
WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "attrs", "parent", "depth", "kids", "chars", "tags", "link_chars", "link_tags", "density", "total", "holds", "plain")

    def __init__(self, tag: str, parent: Node | None, attrs: dict[str, str]):
        self.tag, self.parent, self.attrs, self.kids = tag, parent, attrs, []
        self.depth = parent.depth + 1 if parent else 0
        self.chars = self.tags = self.link_chars = self.link_tags = self.plain = 0
        self.density = self.total = 0.0
        self.holds = False


def _unescape(text: str) -> str:
    if "&#" in text:  # longer numbers are no characters, and too long to be read as numbers
        text = LONG.sub("\ufffd", ZEROS.sub(r"\1", text))
    return html.unescape(text) if "&" in text else text


class Tree:
    """A page's nodes and strings under one root named ``html``. Every letter is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.unclosed = page, {'"': False, "'": False}
        self.root = self.here = Node("html", None, {})
        self.open: dict[str, int] = defaultdict(int, html=1)
        self._read()

    def _read(self) -> None:
        page, at, end = self.page, 0, len(self.page)
        last = page.rfind(">")
        while at < end:
            lt = page.find("<", at)
            while 0 <= lt < end - 1 and not (page[lt + 1] in "!?/" or page[lt + 1].isascii() and page[lt + 1].isalpha()):
                lt = page.find("<", lt + 1)
            stop = end if lt < 0 or lt >= end - 1 else lt
            if stop > at:
                self.here.kids.append(_unescape(page[at:stop]))
            if stop == end:
                return
            at = self._comment(lt) if page[lt + 1] in "!?" else self._tag(lt, last)

    def _comment(self, lt: int) -> int:
        page = self.page
        if page.startswith("<!--", lt):
            if page.startswith((">", "->"), lt + 4):
                return page.find(">", lt + 4) + 1
            close = page.find("-->", lt + 4)
            return close + 3 if close >= 0 else len(page)
        close = page.find(">", lt)
        return close + 1 if close >= 0 else len(page)

    def _tag_end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag, quoted values passed over; -1: none."""
        page = self.page
        while m := STOP.search(page, at):
            q = m[0]
            if q == ">":
                return m.start()
            at = m.end()
            before = at - 2
            while page[before].isspace():
                before -= 1
            if page[before] == "=" and not self.unclosed[q]:
                close = page.find(q, at)
                if close < 0:
                    self.unclosed[q] = True
                else:
                    at = close + 1
        return -1

    def _tag(self, lt: int, last: int) -> int:
        page, closing = self.page, self.page[lt + 1] == "/"
        m = NAME.match(page, lt + 1 + closing) if lt < last else None
        if not m:  # no tag: an odd end tag, or one that the page's end cuts off
            close = page.find(">", lt) if lt < last else -1
            return close + 1 if close >= 0 else len(page)
        gt = self._tag_end(m.end())
        if gt < 0:
            return len(page)
        tag, rest, at = m[0].lower(), page[m.end() : gt], gt + 1
        if closing:
            if self.open[tag] and tag != "html":
                while self.here.tag != tag:
                    self._up()
                self._up()
            return at
        if tag in ("html", "body") and self.open[tag]:
            return at
        if tag in BLOCK and self.open["p"]:
            self._close({"p"}, BLOCK - {"p"})
        if tag in CLOSED_BY and any(self.open[t] for t in CLOSED_BY[tag][0]):
            self._close(*CLOSED_BY[tag])
        node = Node(tag, self.here, {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(rest)} if rest and not rest.isspace() else {})
        self.here.kids.append(node)
        if tag in RAW:
            if not rest.endswith("/"):
                close = RAW_END[tag].search(page, at)
                gt = page.find(">", close.end()) if close else -1
                return gt + 1 if gt >= 0 else len(page)
        elif tag not in VOID and node.depth < DEPTH:  # as browsers do, a slash does not close it
            self.here = node
            self.open[tag] += 1
        return at

    def _up(self) -> None:
        if self.here.parent is not None:
            self.open[self.here.tag] -= 1
            self.here = self.here.parent

    def _close(self, ends: set[str], within: set[str] | frozenset[str]) -> None:
        """Closes the nearest of ``ends``, and those right around it, looked for inside the nearest of ``within``."""
        node = self.here
        while node.tag not in ends:
            if node.tag in within or node.parent is None:
                return
            node = node.parent
        while node.parent is not None and node.parent.tag in ends:
            node = node.parent
        while self.here is not node:
            self._up()
        self._up()


def parse(page: str) -> Node:
    return Tree(page).root


def _path(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def _marks(node: Node) -> set[str]:
    """Words of ``CUT_WORDS`` in those class names and ids that say nothing else."""
    out: set[str] = set()
    if node.attrs:
        for name in f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".lower().split():
            words = set(WORD.findall(name))
            if words <= CUT_WORDS | PLAIN_WORDS:
                out |= words & CUT_WORDS
    return out


COMMENTS = frozenset({"comment", "comments", "commentlist"})


def _cut(node: Node, inside: bool, whole: int) -> bool:
    """``inside``: an ``article`` or ``main`` is around the node; ``whole``: the page's characters outside links and cut tags."""
    tag, a = node.tag, node.attrs
    if tag in CUT_TAGS:
        return True
    if tag in ("html", "body", "main"):
        return False
    marks = _marks(node)
    if tag == "article":
        return bool(marks & COMMENTS) and node.plain <= NEARLY_ALL * whole
    if tag == "form":
        return not node.holds
    if tag == "header":
        return not inside
    if not a:
        return False
    if a.get("role", "").lower() in CUT_ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    names = f"{a.get('class', '')} {a.get('id', '')}".lower().split()
    if not inside and not node.holds and not HEADERS.isdisjoint(names):
        return True
    if marks & COMMENTS:
        return node.plain <= NEARLY_ALL * whole
    return bool(marks) and not node.holds and node.plain <= (HALF if CUT_WORDS.isdisjoint(names) else NEARLY_ALL) * whole


def _ordered(root: Node) -> list[Node]:
    """Parents before children, in page order."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [k for k in reversed(n.kids) if isinstance(k, Node)]
    return out


def _article(node: Node) -> bool:
    return node.tag == "main" or node.tag == "article" and not _marks(node) & COMMENTS


def measure(root: Node) -> list[Node]:
    """Cuts what is no article and sets every node's density and sum."""
    for n in reversed(_ordered(root)):
        if n.parent is not None and (n.holds or _article(n)):
            n.parent.holds = True
        if n.tag != "a":
            n.plain = sum(sum(map(len, k.split())) if isinstance(k, str) else k.plain for k in n.kids if isinstance(k, str) or k.tag not in CUT_TAGS)
    todo = [(root, False)]
    while todo:
        n, inside = todo.pop()
        inside = inside or n.tag in ("article", "main")
        n.kids = [k for k in n.kids if isinstance(k, str) or not _cut(k, inside, root.plain)]
        todo += [(k, inside) for k in n.kids if isinstance(k, Node)]
    nodes = _ordered(root)
    for n in reversed(nodes):
        for k in n.kids:
            if isinstance(k, str):
                n.chars += sum(map(len, k.split()))
            else:
                n.chars += k.chars
                n.tags += k.tags + 1
                n.link_chars += k.link_chars
                n.link_tags += k.link_tags + (k.tag == "a")
        if n.tag == "a":
            n.link_chars = n.chars
    share = root.link_chars / max(root.chars, 1)
    for n in nodes:
        if n.chars:
            c, t, lc, lt = n.chars, max(n.tags, 1), n.link_chars, n.link_tags
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            n.density = c / t * max(math.log(c / max(lc, 1) * t / max(lt, 1)), 0.0) / base
    for n in nodes:
        n.total = sum(k.density for k in n.kids if isinstance(k, Node) and k.tag in BLOCK)
    return nodes


def chosen(root: Node) -> tuple[list[Node], float]:
    """The subtrees that are the text, in page order, and the threshold of their densities."""
    nodes = measure(root)
    if not root.chars:
        return [], 0.0
    core = max(nodes, key=lambda n: n.total)
    if core.total <= 0:  # no node has children with text
        return [root], 0.0
    path = list(_path(core))
    threshold = min(n.density for n in path if n.parent is not None or n is core)
    inner = [n for n in path if n.tag not in ("html", "body")]
    if not inner:
        return [core], threshold
    top = inner[0]
    for low, high in zip(inner, inner[1:]):
        if any(k is not low and (k.density >= threshold or k.tag in TEXTS and k.link_chars < LINKED * k.chars) for k in high.kids if isinstance(k, Node)):
            top = high
    body = inner[-1].parent
    return [top if k is inner[-1] else k for k in body.kids if k is inner[-1] or isinstance(k, Node) and k.density >= threshold], threshold


def extract(page: str | None) -> str:
    """The page's main text: blocks in page order, one line each."""
    if not page:
        return ""
    tops, threshold = chosen(parse(page))
    return "\n".join(line for top in tops for line in _blocks(top, threshold))


def _menu(node: Node, threshold: float) -> bool:
    return node.tag in BLOCK and node.density < threshold and node.link_tags >= LINKS and node.link_chars >= LINKED * node.chars


def _blocks(top: Node, threshold: float) -> list[str]:
    """Texts of the blocks below ``top``, white space collapsed, empty ones left out."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(line).split()):
            out.append(text)
        line.clear()

    todo: list[Node | str | None] = [top]
    while todo:
        n = todo.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            line.append(n)
        elif n.tag == "br":
            line.append(" ")
        elif n is top or not _menu(n, threshold):
            if n.tag in BLOCK:
                flush()
                todo.append(None)
            todo += reversed(n.kids)
    flush()
    return out


@F.pandas_udf(StringType())
def _extract_udf(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield pd.Series([extract(x) for x in batch], dtype=object)


def main_text(html_column: Column) -> Column:
    return _extract_udf(html_column)


def extract_pages(pages: DataFrame, html_column: str = "html", output: str = "text") -> DataFrame:
    """``pages`` with the column ``output``: the main text, never null."""
    return pages.withColumn(output, main_text(F.col(html_column)))
