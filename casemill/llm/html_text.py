"""Main text of web pages by composite text density.

**Densities.** A page is parsed to its elements (unclosed ones are closed as browsers do). For every block element the
composite density is its characters per tag times a logarithm that falls with the share of link characters and link
tags: ``C/T * log_b(C/LC * T/LT)`` with ``b = ln(C/(C-LC) * LC + LC_body/C_body * C + e)``, zero counts taken as one;
in a body without links it is ``C/T``. Inline elements count as tags of their block. A block's sum is that of the densities of its child blocks.

**Choice.** Elements that say what they are (menus, page headers and footers, sidebars, notices, adverts, forms, reader
comments, by element, ARIA role, or a word of class or id; scripts, styles, hidden parts) are left out. Of the rest the block with the
largest sum is taken; the threshold is the least density on its path to the body. The choice grows to the article
element around it if there is one, otherwise to its ancestors as long as there is text of at least the threshold beside it; beside the
path, blocks below it that are mostly links are left out. Everything else in the chosen part stays.

**Text.** Character references are decoded, white space of a block becomes one space, blocks are joined by a newline;
``br`` is white space. A null or empty page, and one without text outside the parts left out, has an empty text.
Every page is a row of its own, also if ids or rows repeat; one pass, no shuffle.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame

from casemill.llm.common import add_columns

_set = lambda names: frozenset(names.split())
VOID = _set("area base br col embed hr img input link meta param source track wbr")
INLINE = _set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr"
)
#: Elements without text of the page, whatever is in them.
SILENT = _set(
    "audio button canvas datalist embed head iframe input link meta noscript object option script select style svg "
    "template textarea title video"
)
#: Elements that are no part of an article.
ASIDE = _set("aside dialog footer form menu nav")
ROLES = _set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search")
WORDS = _set(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pagination "
    "popup promo promotion related replies responses share sharing sidebar signup social sponsor sponsored subscribe"
)
#: Words that say the opposite: a page part with one of them is looked into.
CONTENT = _set("article body content entry main post story text")
#: What a start tag closes: tags, and where the search for an open one ends.
_BLOCK_CLOSES_P = _set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre section table ul"
)
_CLOSES = {
    "li": (_set("li"), _set("ul ol menu dir")),
    "dt": (_set("dt dd"), _set("dl")),
    "dd": (_set("dt dd"), _set("dl")),
    "tr": (_set("tr td th"), _set("table")),
    "td": (_set("td th"), _set("table tr")),
    "th": (_set("td th"), _set("table tr")),
    "option": (_set("option"), _set("select datalist")),
    "thead": (_set("thead tbody tfoot tr td th"), _set("table")),
    "tbody": (_set("thead tbody tfoot tr td th"), _set("table")),
    "tfoot": (_set("thead tbody tfoot tr td th"), _set("table")),
    "a": (_set("a"), _BLOCK_CLOSES_P),
    "body": (_set("head"), frozenset()),
}
_WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Element:
    __slots__ = ("tag", "parent", "parts", "out", "chars", "tags", "link_chars", "links", "density", "sum")

    def __init__(self, tag: str, parent: Element | None, out: bool):
        self.tag, self.parent, self.out = tag, parent, out
        self.parts: list = []  # texts and elements
        self.chars = self.tags = self.link_chars = self.links = 0
        self.density = self.sum = 0.0


def left_out(tag: str, attributes: list, in_article: bool) -> bool:
    """Whether an element says that it is no part of the main text."""
    if tag in SILENT or tag in ASIDE:
        return True
    if tag in ("html", "body", "main"):
        return False
    if tag == "header" and not in_article:
        return True
    words: set[str] = set()
    for name, value in attributes:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if not value:
            continue
        if name == "role" and value.strip().lower() in ROLES or name == "style" and _HIDDEN.search(value):
            return True
        if name in ("class", "id"):
            for part in value.split():
                found = [w.lower() for w in _WORD.findall(part)]
                if found[:1] not in (["no"], ["has"], ["with"], ["without"]):
                    words.update(found)
    return not words.isdisjoint(WORDS) and (words.isdisjoint(CONTENT) or not words.isdisjoint(("comment", "comments")))


class Page(HTMLParser):
    """The elements of a page, in page order."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Element("html", None, False)
        self.all = [self.root]
        self.articles = 0  # open ones
        self.open: dict[str, int] = {}
        self.feed(html)
        self.close()

    def _up(self) -> None:
        self.open[self.now.tag] -= 1
        self.articles -= self.now.tag in ("article", "main")
        self.now = self.now.parent

    def _close(self, tags, stops) -> None:
        at = self.now
        while at.parent is not None and at.tag not in stops:
            if at.tag in tags:
                while self.now is not at:
                    self._up()
                self._up()
                return
            at = at.parent

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag in _BLOCK_CLOSES_P and self.open.get("p"):
            self._close(("p",), ("table", "td", "th", "button"))
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        made = Element(tag, self.now, left_out(tag, attrs, self.articles > 0))
        self.now.parts.append(made)
        self.all.append(made)
        if tag not in VOID:
            self.now = made
            self.open[tag] = self.open.get(tag, 0) + 1
            self.articles += tag in ("article", "main")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML, but for void elements

    def handle_endtag(self, tag):
        if self.open.get(tag) and tag not in VOID and tag != "html":
            # An inline end tag doesn't close blocks.
            self._close((tag,), _BLOCK_CLOSES_P if tag in INLINE else ())

    def handle_data(self, data):
        self.now.parts.append(data)


def composite(chars: int, tags: int, link_chars: int, links: int, share: float) -> float:
    """The composite density of a node; ``share`` is that of link characters in the body."""
    tags = max(tags, 1)
    if not chars or not share:
        return chars / tags
    base = log(chars / max(chars - link_chars, 1) * link_chars + share * chars + e)
    return chars / tags * log(chars / max(link_chars, 1) * tags / max(links, 1)) / log(base)


def measure(page: Page) -> Element:
    """Fill in counts, densities and sums; the result is the body."""
    body = next((x for x in page.all if x.tag == "body"), page.root)
    contains = {id(x) for x in page.all if x.tag in ("article", "main") and not x.out}
    for x in reversed(page.all):  # children come after their parents
        if id(x) in contains and x.parent is not None:
            contains.add(id(x.parent))
        # A wrapper of an article is looked into, whatever it is called.
        if x.out and id(x) in contains and x.tag not in SILENT:
            x.out = False
        x.chars += sum(len(" ".join(t.split())) for t in x.parts if type(t) is str)
        if x.tag == "a":
            x.link_chars, x.links = x.chars, x.links + 1
        if x.parent is not None and x.tag not in SILENT:
            up = x.parent
            up.chars += x.chars
            up.tags += x.tags + 1
            up.link_chars += x.link_chars
            up.links += x.links
    share = body.link_chars / max(body.chars, 1)
    for x in reversed(page.all):
        if not x.out and x.tag not in INLINE:
            x.density = composite(x.chars, x.tags, x.link_chars, x.links, share)
            if x.parent is not None:
                x.parent.sum += x.density
    return body


def inside(x: Element, body: Element) -> bool:
    """Whether neither the element nor one around it, up to the body, is left out."""
    while x is not body:
        if x is None or x.out:
            return False
        x = x.parent
    return True


def chosen(page: Page, body: Element) -> tuple[Element, set[int]]:
    """The element of the main text, and the elements in it that are left out as lists of links."""
    seen = {id(body)}
    best = body
    for x in page.all:  # parents come before their children
        if x is not body and (x.out or id(x.parent) not in seen):
            continue
        seen.add(id(x))
        if x.tag not in INLINE and x.sum > best.sum:
            best = x
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min(x.density for x in path)
    for tag in ("article", "main"):
        around = [x for x in path if x.tag == tag]
        if around:
            return around[-1], set()
    on_path = {id(x) for x in path}
    beside = [
        [y for y in x.parts if type(y) is not str and not y.out and y.tag not in INLINE and id(y) not in on_path] for x in path
    ]
    top, links = 0, set()
    for i, blocks in enumerate(beside[1:], 1):
        if any(y.density >= threshold and 2 * y.link_chars < y.chars for y in blocks):
            top = i
    for blocks in beside[: top + 1]:
        links.update(id(y) for y in blocks if y.density < threshold and 2 * y.link_chars > y.chars)
    return path[top], links


def blocks_of(top: Element, links: set[int]) -> list[str]:
    """The texts of the blocks in page order."""
    out, words = [], []

    def end():
        text = " ".join("".join(words).split())
        if text:
            out.append(text)
        words.clear()

    work = [iter(top.parts)]
    blocks = [True]
    while work:
        part = next(work[-1], None)
        if part is None:
            work.pop()
            if blocks.pop():
                end()
        elif type(part) is str:
            words.append(part)
        elif part.out or id(part) in links:
            if part.tag not in INLINE:
                end()
        elif part.tag == "br":
            words.append(" ")
        else:
            block = part.tag not in INLINE
            if block:
                end()
            work.append(iter(part.parts))
            blocks.append(block)
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Page(html)
    top, links = chosen(page, measure(page))
    return "\n".join(blocks_of(top, links))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (its code points) instead of the markup; other columns stay."""

    def make():
        def work(batch: pa.RecordBatch) -> list:
            column = batch.column(batch.schema.get_field_index(html))
            texts = [main_text(x.as_py()) for x in column]
            return [texts, list(map(len, texts))]

        return work

    return add_columns(pages, "text string, n_chars bigint", make, (html,))
