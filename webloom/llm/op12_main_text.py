"""Main text of web pages by tree scoring.

A page is read into a tree of elements and into text blocks, each with the element that holds it. Elements that are
no article by their kind, role or name are left out with all they hold. Every block gives points for its length and
its commas to the element around it and, in falling shares, to the elements further out; an element's points are
discounted by its link density. The element with most points is the container, or the article it stands in. Its
blocks and those of good siblings are the text.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import add_columns, read_table

MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>", re.S)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|\baria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
UNFINISHED = re.compile(r"<[a-zA-Z/!?]")

# Fixed values of HTML: elements without content, with raw content, that begin and end a text block, that an opening
# element closes.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
BLOCKS = frozenset((
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu",
    "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
))
CLOSED_BY = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)), "option": (("option",), ("select",)), "body": (("head",), ()),
}
#: Elements whose start ends an open paragraph, and those in which a paragraph outside of them stays open.
ENDS_P = BLOCKS - {"body", "caption", "dd", "dt", "head", "html", "li", "tbody", "td", "tfoot", "th", "thead", "tr"}
KEEPS_P = frozenset(("td", "th", "caption", "button", "object", "html"))

# What is never article text: by element, by role, by a word of its class or id.
NEVER = frozenset((
    "script", "style", "noscript", "template", "title", "head", "iframe", "noembed", "noframes", "object", "svg", "math", "canvas", "audio", "video",
    "button", "select", "option", "textarea", "input", "datalist", "nav", "menu", "dialog", "search", "footer", "aside",
))
OUTER = frozenset(("header", "form", "fieldset"))
ROLES = frozenset((
    "alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar", "tooltip",
))
WORDS = frozenset((
    "ad", "ads", "adsense", "advert", "advertisement", "advertising", "adverts", "adv", "banner", "sponsor", "sponsored", "sponsors", "promo", "promoted",
    "promotion", "nav", "navbar", "navi", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "crumbs", "topbar", "toolbar", "masthead", "header",
    "footer", "footers", "colophon", "copyright", "sidebar", "sidebars", "aside", "rail", "widget", "widgets", "cookie", "cookies", "consent", "gdpr",
    "notice", "notices", "alert", "popup", "popups", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing",
    "social", "related", "recommended", "recommendations", "trending", "pagination", "pager", "comment", "comments", "commentlist", "disqus", "respond",
    "replies", "reply", "discussion", "skip", "hidden",
))
#: Words of a class or id that speak for an article.
GOOD = frozenset(("article", "content", "entry", "main", "post", "story"))
#: Elements that mark an article as such; one that holds them is no boilerplate, whatever its name.
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
LISTS = frozenset(("ul", "ol", "dl", "table"))
#: Elements that are paragraphs or the like: their points go to the element around them.
LEAVES = HEADINGS | {"p", "pre", "li", "dt", "dd", "td", "th", "figcaption", "blockquote"}
COMMAS = re.compile("[,،、，]")

#: Points of a block, besides its commas: one, and one for each so many characters.
CHARS = 100
#: Elements that take a share of a block's points: its container in full, the next one out half, the third a third, ...
FAR = 8
#: Share of the container's points that a sibling needs; a list of at least so many links is no text from this link density on.
SIBLING, LIST_LINKS, LINKED = 0.2, 3, 0.5
#: A form of so many paragraphs holds the page.
FORM_PARAGRAPHS = 2


class Node:
    __slots__ = ("tag", "attrs", "parent", "out", "holds", "words", "points", "chars", "linked", "links", "paragraphs", "titled", "kept", "listed")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.words: list[str] = []
        self.holds = self.titled = False
        self.paragraphs = 0

    def clear(self) -> None:
        self.out = self.kept = self.listed = False
        self.points = 0.0
        self.chars = self.linked = self.links = 0


class Block:
    """A stretch of text between block borders, with the element that holds it, its characters in links and its links."""

    __slots__ = ("node", "text", "linked", "links")

    def __init__(self, node: Node, text: str, linked: int, links: int):
        self.node, self.text, self.linked, self.links = node, text, linked, links


def plain(text: str) -> str:
    return " ".join((unescape(text) if "&" in text else text).split())


class Reader:
    """Nodes and blocks of a page, both in page order; open, crossed and missing tags are closed as HTML does."""

    def __init__(self, html: str):
        root = Node("#page", "", None)
        self.nodes, self.blocks, self.stack = [root], [], [root]
        self.open: Counter[str] = Counter()
        self.pieces: list[tuple[str, bool]] = []  # of the current block, with whether they stand in a link
        self.links = 0
        at, last = 0, html.rfind(">")
        while at <= last:
            m = MARKUP.search(html, at)
            if m is None:
                break
            if m.start() > at:
                self.text(html[at : m.start()])
            at = m.end()
            slash, tag, attrs = (m.group(1), m.group(2), m.group(3)) if m.group(2) else (m.group(4), m.group(5), m.group(6))
            if tag is None:
                continue
            tag = tag.lower()
            if slash:
                self.end(tag)
            else:
                self.begin(tag, attrs)
                if tag in RAW:
                    at = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(html, at).end()
        rest = html[at:]
        cut = UNFINISHED.search(rest)  # a tag or comment that the page's end cuts off
        self.text(rest[: cut.start()] if cut else rest)
        self.border()

    def text(self, piece: str) -> None:
        if piece:
            self.pieces.append((piece, self.open["a"] > 0))

    def border(self) -> None:
        if self.pieces:
            text = plain("".join(p for p, _ in self.pieces))
            if text:
                inside = sum(len(plain(p)) for p, linked in self.pieces if linked)
                holder = next(n for n in reversed(self.stack) if n.tag in BLOCKS or n.tag in NEVER or n.parent is None)
                self.blocks.append(Block(holder, text, min(inside, len(text)), self.links))
            self.pieces.clear()
        self.links = 0

    def close(self, to: int) -> None:
        if any(n.tag in BLOCKS or n.tag in NEVER for n in self.stack[to:]):
            self.border()
        self.open.subtract(n.tag for n in self.stack[to:])
        del self.stack[to:]

    def closed(self, tags: tuple[str, ...], fence: frozenset | tuple[str, ...]) -> None:
        if not any(self.open[t] for t in tags):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                return self.close(i)
            if self.stack[i].tag in fence:
                return

    def end(self, tag: str) -> None:
        if tag == "br":
            self.text(" ")
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                return self.close(i)
            # the end of an inline element does not end a block around it
            if tag not in BLOCKS and self.stack[i].tag in BLOCKS:
                return

    def begin(self, tag: str, attrs: str) -> None:
        if tag in ENDS_P:
            self.closed(("p",), KEEPS_P)
        if tag in CLOSED_BY:
            self.closed(*CLOSED_BY[tag])
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.close(len(self.stack) - 1)
        if tag == "a":
            self.closed(("a",), BLOCKS)
        if tag in BLOCKS or tag in NEVER:
            self.border()
        elif tag == "br":
            self.text(" ")
        node = Node(tag, attrs, self.stack[-1])
        self.nodes.append(node)
        if tag not in VOID and tag not in RAW and not (attrs.endswith("/") and self.open["svg"]):
            self.stack.append(node)
            self.open[tag] += 1
            self.links += tag == "a"


def names(attrs: str) -> tuple[list[str], str]:
    """(words of class and id, role)"""
    words, role = [], ""
    for key, *values in NAMES.findall(attrs):
        value = unescape("".join(values))
        if key.lower() == "role":
            role = value.strip().lower()
        else:
            words += [w.lower() for w in PIECE.findall(value)]
    return words, role


def describe(nodes: list[Node]) -> None:
    """What an element is named and what it holds: an article, paragraphs, a title."""
    for n in nodes:
        if "=" in n.attrs:
            n.words, role = names(n.attrs)
            if role in ROLES:
                n.words.append(f"role {role}")
    for n in reversed(nodes):
        n.holds = n.holds or (n.tag in ARTICLE and not bad(n))
        n.titled = n.titled or n.tag == "h1"
        n.paragraphs += n.tag == "p"
        if n.parent is not None:
            n.parent.holds = n.parent.holds or n.holds
            n.parent.titled = n.parent.titled or n.titled
            n.parent.paragraphs += n.paragraphs


def bad(n: Node) -> set[str]:
    return {w for w in n.words if w in WORDS or w.startswith("role ")}


def mark(nodes: list[Node], by_name: bool) -> None:
    """Marks the elements that are left out, with all they hold."""
    inside: dict[Node, bool] = {nodes[0]: False}
    has_article = any(n.tag == "article" for n in nodes)
    for n in nodes[1:]:
        wrong = bad(n) if n.words else set()
        whole = n.tag in ("html", "body")
        good = n.tag == "article" or (n.tag == "main" and not has_article) or (not whole and not GOOD.isdisjoint(n.words))
        inside[n] = inside[n.parent] or (good and not wrong)
        if n.parent.out or (n.attrs and not whole and HIDDEN.search(n.attrs)):
            n.out = True
        elif whole:
            n.out = False
        elif n.tag == "form":  # some pages are one form
            n.out = not n.holds and n.paragraphs < FORM_PARAGRAPHS
        elif n.tag in NEVER or (n.tag in OUTER and not inside[n]):
            n.out = not n.holds
        elif inside[n.parent] and (n.tag == "header" or wrong == {"header"}):
            n.out = False  # the head of the article itself
        else:
            n.out = by_name and bool(wrong) and not n.holds


def weigh(nodes: list[Node], blocks: list[Block]) -> None:
    """Points, characters and linked characters of all elements, from the blocks that are not left out."""
    for b in blocks:
        if b.node.out:
            continue
        points = 1 + len(COMMAS.findall(b.text)) + len(b.text) / CHARS
        # a block's own element is the first around it, unless that is a paragraph or the like
        n, far = b.node, 1
        if n.tag in LEAVES:
            n = n.parent or n
        while n is not None and far <= FAR:
            n.points += points / far
            n, far = n.parent, far + 1
        b.node.chars += len(b.text)
        b.node.linked += b.linked
        b.node.links += b.links
    for n in reversed(nodes[1:]):
        n.parent.chars += n.chars
        n.parent.linked += n.linked
        n.parent.links += n.links


def worth(n: Node) -> float:
    return n.points * (1 - n.linked / n.chars) if n.chars else 0.0


def around(n: Node | None, tags: tuple[str, ...]) -> Node | None:
    while n is not None and n.tag not in tags:
        n = n.parent
    return n


def container(rated: list[Node]) -> Node:
    """The element with most points, or the article it stands in or holds."""
    best = max(rated, key=worth)
    for tag in ("article", "main"):
        marked = [n for n in rated if n.tag == tag]
        if marked:
            return around(best, (tag,)) or max(marked, key=worth)
    return (around(best, ("table",)) if best.tag in ("tr", "tbody", "thead") else None) or best


def sibling(other: Node, top: Node) -> bool:
    """Belongs to the text beside ``top``."""
    if other.out or not other.chars or other.linked > LINKED * other.chars or (top.tag in ARTICLE and other.tag not in ARTICLE):
        return False
    return worth(other) >= SIBLING * worth(top) or other.titled or other.tag in ("p", "pre", "blockquote") or other.tag in HEADINGS


def main_text(html: str) -> str:
    """The blocks of the main text, joined by line feeds."""
    page = Reader(html)
    nodes, blocks = page.nodes, page.blocks
    describe(nodes)
    for by_name in (True, False):
        for n in nodes:
            n.clear()
        mark(nodes, by_name)
        weigh(nodes, blocks)
        # a page that marks its article has said what it is, even where that is empty
        if nodes[0].chars or any(n.tag in ARTICLE for n in nodes):
            break
    rated = [n for n in nodes if n.chars and not n.out]
    if not rated:
        return ""
    top = container(rated)
    for n in nodes:
        n.kept = n is top or (n.parent is not None and (n.parent.kept or (n.parent is top.parent and sibling(n, top))))
        links = n.tag in LISTS and n.links >= LIST_LINKS and n.linked > LINKED * n.chars
        n.listed = links or (n.parent is not None and n.parent.listed)
    return "\n".join(b.text for b in blocks if b.node.kept and not b.node.out and not b.node.listed)


FIELDS = [T.StructField("main_text", T.StringType())]


def extract_main_text(df: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Adds main_text: the article of the page in ``html``, one line per block.

    Character references are decoded, white space inside a block is one space, a line break counts as white space. A
    null, empty or wordless page, and one whose article is empty, gives an empty text; markup that is cut off is read as
    far as it goes. Every row is read by itself, repeated rows alike. A column ``main_text`` of the input is replaced.
    No rows give no rows.
    """
    return add_columns(df, html, FIELDS, lambda pages: [pa.array(list(map(main_text, pages)), pa.string())], keep)


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    found = extract_main_text(read_table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


#: The same where, as in the given tables, the article is an element of that name: tags of blocks become line ends.
SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)(?:</article>|$)', 1) AS body FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(body, '\s+', ' ', 'g'), '</?(?:p|h[1-6]|div|li|ul|ol)(?: [^>]*)?>', chr(10), 'g'), '<br ?/?>', ' ', 'g') AS body FROM a),
c AS (SELECT page_id, url, regexp_replace(replace(replace(replace(replace(regexp_replace(body, '<[^>]*>', '', 'g'), '&quot;', '"'), '&#x27;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS body FROM b),
d AS (SELECT page_id, url, array_to_string(list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d
"""
