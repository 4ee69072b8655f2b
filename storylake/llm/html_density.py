"""Main text of web pages by composite text density (Sun, Song and Liao 2011).

A page becomes a small tree. Elements that never hold the article (menus,
headers, footers, sidebars, adverts, forms, scripts, reader comments) are left
out. For every other node the density is its characters per tag, adjusted for
the share of link text; a node's density sum adds those of its children. The
node with the greatest sum is the core. The least density on the path from the
core to the body is the threshold: neighbours of the core that reach it, by their
own density and by their sum, belong to the article as well. If what is found lies inside an ``<article>`` (or else a
``<main>``), it is widened to the nearest one; these tags never narrow it.

The threshold also decides below the core: blocks whose class or id merely
hints at something else (``share-price``) stay if they are as dense, and lists
of links go if they are not.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template head nav footer aside form iframe object svg math button select textarea dialog menu canvas audio video map datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr ruby rt rp".split())
#: A start tag of the key closes an open element of the value first.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"},
}
#: Elements that an implied end doesn't reach beyond.
SCOPES = frozenset("html body table ul ol dl article section main div td th blockquote aside nav form header footer".split())
#: Words of a class or id that name what is no article, and words that say nothing beside them.
SENSE = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsors sponsored promo promos promotion banner sidebar menu menus nav navbar navigation
    breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription share sharing
    social related recommended comment comments disqus respond replies pagination pager widget widgets toolbar""".split()
)
NEUTRAL = frozenset(
    """area bar block body bottom box buttons center col column container content cta first footer form global group header holder icons inline inner item
    items large last left link links list main message page panel post posts primary right section secondary side site slot small top unit web wrap wrapper zone""".split()
)
#: Words that inside an article are as likely its subject: there links and density alone decide.
TOPICS = frozenset("social comment notice notices banner promotion subscription consent share header respond sponsor".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Elements whose class never counts against them.
TRUSTED = frozenset("html body article main".split())
#: Elements that hold a piece of text; a name that merely hints counts against them only if they are mostly links.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption".split()) | INLINE
#: Elements that may be a list of links.
LISTS = frozenset("ul ol dl div section table".split())


class Node:
    __slots__ = ("tag", "parent", "depth", "parts", "dropped", "doubtful", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag, parent=None, dropped=False, doubtful=False):
        self.tag, self.parent, self.dropped, self.doubtful, self.parts = tag, parent, dropped, doubtful, []
        self.depth = parent.depth + 1 if parent else 0
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


class _Tree(HTMLParser):
    """Builds the tree; end tags that are missing are implied where HTML implies them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html")
        self.nodes = [self.root]
        # Open elements by tag, those that hold blocks, and those that implied ends stop at; the innermost stands last.
        self.open, self.blocks, self.scopes = defaultdict(list), [self.root], [self.root]

    def parse_marked_section(self, i, report=1):
        """Sections such as ``<![if x]>`` have no meaning in a page and are skipped, whatever they hold."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def handle_starttag(self, tag, attributes):
        if tag == "html":
            return
        if tag in VOID:
            if tag == "br":
                self.at.parts.append(" ")
            return
        if tag not in INLINE:
            self._imply({"p"})
        if tag in CLOSES:
            self._imply(CLOSES[tag])
        surely, perhaps = self._noise(tag, dict(attributes))
        node = Node(tag, self.at, self.at.dropped or surely, perhaps)
        self.at.parts.append(node)
        self.nodes.append(node)
        for stack in self._stacks(tag):
            stack.append(node)
        self.at = node

    def _stacks(self, tag):
        return [self.open[tag], *[self.blocks] * (tag not in INLINE), *[self.scopes] * (tag in SCOPES)]

    def handle_endtag(self, tag):
        if self.open[tag] and (tag not in INLINE or self.blocks[-1].depth < self.open[tag][-1].depth):
            self._close(self.open[tag][-1])

    def handle_startendtag(self, tag, attributes):
        self.handle_starttag(tag, attributes)
        if tag not in VOID and tag in ("svg", "path", "math"):
            self.handle_endtag(tag)

    def handle_data(self, data):
        if not self.at.dropped:
            self.at.parts.append(data)

    def _close(self, node):
        """End ``node`` and all that is open inside it."""
        while self.at is not node.parent:
            for stack in self._stacks(self.at.tag):
                stack.pop()
            self.at = self.at.parent

    def _imply(self, tags):
        """End the open elements of these tags, as far as no scope hides them."""
        while found := [self.open[t][-1] for t in tags if self.open[t]]:
            node = max(found, key=lambda n: n.depth)
            if node.depth < self.scopes[-1].depth:
                return
            self._close(node)

    def _noise(self, tag, attributes):
        """(surely, perhaps): whether an element holds no part of an article."""
        if tag in DROPPED or attributes.get("role", "") in ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
            return (tag != "header" or not (self.open["article"] or self.open["main"])), False
        names = f"{attributes.get('class') or ''} {attributes.get('id') or ''}".lower().split()
        if tag in TRUSTED or not names:
            return False, False
        parts = [[w for w in re.split(r"[-_]+|[0-9]+", n) if w] for n in names]
        marked = [p for p in parts if SENSE.intersection(p)]
        if self.open["article"] or self.open["main"]:
            marked = [p for p in marked if not TOPICS.issuperset(SENSE.intersection(p))]
        return any(SENSE.issuperset(w for w in p if w not in NEUTRAL) for p in marked), bool(marked)


def _measure(nodes: list[Node]) -> None:
    """Characters, tags and their link parts of every node, then densities and sums (children first)."""
    for node in reversed(nodes):
        if node.dropped:
            continue
        for part in node.parts:
            if isinstance(part, str):
                node.chars += len(part.strip())
            elif not part.dropped:
                node.chars += part.chars
                node.tags += part.tags + 1
                node.link_chars += part.link_chars
                node.link_tags += part.link_tags + (part.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    body = nodes[0]
    share = body.link_chars / max(1, body.chars)
    for node in nodes:
        if not node.dropped and node.chars:
            c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
            base = math.log(c / max(1, c - node.link_chars) * node.link_chars + share * c + math.e)
            node.density = c / t * max(0.0, math.log(max(1.0, c / lc * t / lt)) / max(1e-9, math.log(max(base, 1.0 + 1e-9))) if base > 1 else math.log(max(1.0, c / lc * t / lt)))
    for node in nodes:
        node.total = sum(p.density for p in node.parts if isinstance(p, Node) and not p.dropped)


def _belongs(node: Node, threshold: float) -> bool:
    """Whether a neighbour of the core is part of the article: as dense as the path, and so is the sum below it unless it is a paragraph itself."""
    return not node.dropped and not node.doubtful and node.density >= threshold > 0 and node.link_chars * 2 < node.chars and (node.tag in TEXTUAL or node.total >= threshold)


def _core(nodes: list[Node]) -> tuple[Node, float]:
    """The node that holds the article, and the threshold of density."""
    best = max((n for n in nodes if not n.dropped and n.tag not in INLINE), key=lambda n: n.total)
    path = [best]
    while path[-1].parent:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    for node in path[:-1]:
        # Beside the core, blocks as dense as the path belong to the article: take the parent while there are any.
        if node.tag == "body" or not any(isinstance(p, Node) and p is not node and _belongs(p, threshold) for p in node.parent.parts):
            continue
        best = node.parent
    above = path[path.index(best) :]
    return next((n for tag in ("article", "main") for n in above if n.tag == tag), best), threshold


def _beside_the_article(node: Node, threshold: float) -> bool:
    """Whether a block below the core is none of the article, as its density tells: a doubtful container, or a list of links."""
    linked = node.link_chars * 2 > node.chars
    doubtful = node.doubtful and (linked or node.tag not in TEXTUAL)
    return (doubtful or linked and node.link_tags > 2 and node.tag in LISTS) and node.density < threshold


def _blocks(node: Node, threshold: float = 0.0) -> list[str]:
    """Text blocks of a subtree in page order, white space inside each as one space."""
    blocks, run = [], []

    def close():
        if text := " ".join("".join(run).split()):
            blocks.append(text)
        run.clear()

    stack = [iter(node.parts)]
    owners = [node]
    while stack:
        part = next(stack[-1], None)
        if part is None:
            if owners.pop().tag not in INLINE:
                close()
            stack.pop()
        elif isinstance(part, str):
            run.append(part)
        elif not part.dropped and not _beside_the_article(part, threshold):
            if part.tag not in INLINE:
                close()
            stack.append(iter(part.parts))
            owners.append(part)
    close()
    return blocks


def main_text(html: str | None) -> str:
    """The article of a page: its blocks joined by line ends; empty if there is none."""
    if not html:
        return ""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    _measure(tree.nodes)
    if not tree.root.chars:
        return ""
    return "\n".join(_blocks(*_core(tree.nodes)))


def extract(pages: DataFrame, carried: dict[str, Column], html_col: str = "html") -> DataFrame:
    """The ``carried`` columns with ``text``, the main text of every page.

    Null, empty and textless pages give an empty text. Repeated rows are
    extracted one by one; an empty table gives an empty result; other columns
    are ignored.
    """
    kept = pages.select(*(c.alias(n) for n, c in carried.items()), F.col(html_col).alias("__html"))
    names = list(carried)

    def run(batches):
        for batch in batches:
            for low in range(0, len(batch), 256):
                some = batch.slice(low, 256)
                texts = [main_text(v.as_py()) for v in some.column(len(names))]
                yield pa.RecordBatch.from_arrays([*some.columns[: len(names)], pa.array(texts, pa.string())], names=[*names, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{schema}, text string")


def page_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page row; see :func:`extract`."""
    found = extract(pages, {"page_id": F.col(id_col), "url": F.col(url_col)}, html_col)
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
