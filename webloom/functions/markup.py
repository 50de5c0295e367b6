"""From HTML text to page parts: the one step that runs in Python.

A page becomes a list of elements in document order (``tag, attributes, start, end`` over one
shared list of text pieces), so that "inside" is a comparison of positions and the text of an
element is a slice. What the parts mean (titles, filters, URLs, scores) is decided by Spark.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

# a piece of text and what follows it: a comment, a declaration, a tag, a mere < or the end; then the parts of a tag
TOKEN = re.compile(r"([^<]*+)(?:<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?[a-zA-Z][^\s/>]*(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(<)|\Z)", re.S)
TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
STEP = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+|\[[^\]]+\])*)")
PART = re.compile(r"([.#])([\w-]+)|\[\s*([\w:-]+)\s*(?:([*^$]?=)\s*[\"']?(.*?)[\"']?\s*)?\]")

# Elements without content, elements read as raw text, and the open elements that a
# new element closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {tag: re.compile(f"</{tag}\\s*>", re.I) for tag in "script style noscript textarea title".split()}
BLOCKS = frozenset((
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
    "section table ul"
).split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tbody": ({"tr", "td", "th", "caption", "thead", "tbody"}, {"table"}),
}
UNREAD = frozenset("script style noscript".split())
FENCES = frozenset("td th li div table button".split())
HEADINGS = tuple((n, f"h{n}") for n in range(1, 7))
COUNTED = frozenset("div span p a img h1 h2 h3 h4 h5 h6 ul ol li table tr td th form input button".split())
#: Bounds of what a reader remembers between pages: entries, and characters of a tag that is remembered.
REMEMBERED, SHORT = 4096, 200


class Element:
    __slots__ = ("tag", "attrs", "start", "end", "index", "last", "parent", "fits", "above")

    def __init__(self, tag, attrs, start, index, parent, fits):
        self.tag, self.attrs, self.parent, self.fits = tag, attrs, parent, fits
        self.start = self.end = start
        self.index = self.last = index
        self.above = 0 if parent is None else parent.above | parent.fits


def attributes(text):
    found = {}
    for name, double, single, bare in ATTRIBUTE.findall(text):
        value = double or single or bare
        found.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return found


def tag_kind(whole, mark):
    """All that the text of a tag settles: whether it closes, its name, attributes and steps, what it ends before it and whether it stays open."""
    closes, tag, inner = TAG.fullmatch(whole).groups()
    tag = tag.lower()
    if closes:
        return True, tag, None, 0, None, None
    attrs = attributes(inner) if inner.strip(" /") else {}
    return False, tag, attrs, mark(tag, attrs), CLOSES.get(tag) or (tag in BLOCKS), RAW.get(tag) or (tag in VOID)


def read(html, known, mark):
    """(elements, texts, steps seen) of a page; open, crossed and missing tags are closed as browsers do.

    ``known`` keeps short tags from page to page, ``mark`` gives the steps that a tag with its attributes fits.
    """
    texts, elements, stack = [], [], []
    at, size, seen = 0, len(html), 0

    def close(upto):
        while len(stack) > upto:
            e = stack.pop()
            e.end, e.last = len(texts), len(elements) - 1

    while at < size:
        # a new pass begins behind each element of raw text
        for m in TOKEN.finditer(html, at):
            piece, whole, mere = m.groups()
            if piece:
                texts.append(unescape(piece) if "&" in piece else piece)
            if whole is None:
                if mere:
                    texts.append("<")
                continue
            kind = known.get(whole)
            if kind is None:
                kind = tag_kind(whole, mark)
                if len(whole) < SHORT:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[whole] = kind
            closes, tag, attrs, fits, ends, content = kind
            if closes:
                if stack and stack[-1].tag == tag:  # as a rule
                    e = stack.pop()
                    e.end, e.last = len(texts), len(elements) - 1
                    continue
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                continue
            if ends is True:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag == "p":
                        close(i)
                        break
                    if stack[i].tag in FENCES:
                        break
            elif ends:
                ended, fence = ends
                cut = None
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag in fence:
                        break
                    if stack[i].tag in ended:
                        cut = i
                if cut is not None:
                    close(cut)
            seen |= fits
            element = Element(tag, attrs, len(texts), len(elements), stack[-1] if stack else None, fits)
            elements.append(element)
            if content is False:
                stack.append(element)
            elif content is not True:
                at = m.end()
                closing = content.search(html, at)
                body = html[at:closing.start()] if closing else html[at:]
                texts.append(unescape(body) if tag in ("title", "textarea") else body)
                element.end = len(texts)
                at = closing.end() if closing else size
                break
        else:
            break
    close(0)
    return elements, texts, seen


# --- selectors: tag, .class, #id, [attr], [attr=v], [attr*=v], descendants, comma lists --------

def compile_selector(selector):
    """List of alternatives, each a list of steps (tag, classes, ids, attribute tests)."""
    alternatives = []
    for text in selector.split(","):
        steps = []
        for word in re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", text.strip()):
            m = STEP.fullmatch(word)
            if m is None:
                raise ValueError(f"selector not understood: {selector}")
            tests = [("." if k == "." else "#", n, None) if k else (op or "has", a, v) for k, n, a, op, v in PART.findall(m.group(2))]
            steps.append(((m.group(1) or "*").lower(), tests))
        alternatives.append(steps)
    return alternatives


def fits(tag, attrs, step):
    wanted, tests = step
    if wanted != "*" and tag != wanted:
        return False
    for kind, name, value in tests:
        if kind == ".":
            if name not in attrs.get("class", "").split():
                return False
        elif kind == "#":
            if attrs.get("id") != name:
                return False
        else:
            have = attrs.get(name)
            if have is None:
                return False
            if kind == "=" and have != value and not (name == "rel" and value in have.split()):
                return False
            if kind == "*=" and value not in have or kind == "^=" and not have.startswith(value) or kind == "$=" and not have.endswith(value):
                return False
    return True


class Steps:
    """The steps of several selectors, a bit for each; elements alike in all that the steps ask for are tested once."""

    def __init__(self):
        self.steps, self.names, self.known = [], (), {}

    def bit(self, step):
        if step not in self.steps:
            self.steps.append(step)
            asked = {{".": "class", "#": "id"}.get(kind, name) for kind, name, _ in step[1]}
            self.names = (*self.names, *sorted(asked.difference(self.names)))
        return 1 << self.steps.index(step)

    def mark(self, tag, attrs):
        """The steps that an element fits."""
        known, names = self.known, self.names
        key = tag if frozenset(names).isdisjoint(attrs) else (tag, *map(attrs.get, names))
        bits = known.get(key)
        if bits is None:
            bits = sum(1 << i for i, step in enumerate(self.steps) if fits(tag, attrs, step))
            if len(known) >= REMEMBERED:
                known.clear()
            if key is tag or sum(len(v) for v in key if v) < SHORT:
                known[key] = bits
        return bits


class Matcher:
    """Several selectors as one test on marked elements."""

    def __init__(self, steps, *selectors):
        self.single, self.chains = 0, []
        for path in (path for s in selectors for path in compile_selector(s)):
            *around, last = map(steps.bit, path)
            if around:
                self.chains.append((last, around[::-1], sum(set(around))))
            else:
                self.single |= last
        self.ends = self.single
        for last, _, _ in self.chains:
            self.ends |= last

    def within(self, seen):
        """Whether a page with these steps can have anything that fits."""
        return bool(seen & self.single) or any(seen & last and seen & every == every for last, _, every in self.chains)

    def __call__(self, element):
        if not element.fits & self.ends:
            return False
        if element.fits & self.single:
            return True
        for last, around, every in self.chains:
            if element.fits & last and element.above & every == every:
                above, left = element.parent, list(around)
                while left and above is not None:
                    if above.fits & left[0]:
                        del left[0]
                    above = above.parent
                if not left:
                    return True
        return False


# --- the parts of one page -----------------------------------------------------------------

class PageReader:
    """Reads pages with fixed options; one instance per task."""

    def __init__(self, drop, main, custom, strategy):
        self.steps, self.known, self.met = Steps(), {}, {}

        def matcher(*selectors):
            return Matcher(self.steps, *selectors)

        self.drop = matcher(*drop)
        self.main = [matcher(s) for s in main]
        self.custom = {name: matcher(s) for name, s in custom.items()}
        self.largest = strategy == "largest"
        self.flags = {
            "has_navigation": matcher("nav, .navigation, .nav, .menu, #navigation"),
            "has_sidebar": matcher(".sidebar, .side-bar, #sidebar, aside"),
            "has_footer": matcher("footer, .footer, #footer"),
        }
        self.pagers = matcher(".pagination a, .pager a, .page-numbers a, a[rel=next], a.next, .next-page a")
        self.articles = matcher(".content-link a, .article-link a, .post-link a")

    def meets(self, seen):
        """What a page with these steps can have: matchers that drop, of the main area, of pagers and articles, flags, names of custom values."""
        found = self.met.get(seen)
        if found is None:
            if len(self.met) >= REMEMBERED:
                self.met.clear()
            drop, pagers, articles = (m if m.within(seen) else None for m in (self.drop, self.pagers, self.articles))
            found = self.met[seen] = (
                drop, [m for m in self.main if m.within(seen)], pagers, articles,
                [(name, m.within(seen) and m) for name, m in self.flags.items()], {name for name, m in self.custom.items() if m.within(seen)})
        return found

    def remove(self, elements, texts, drop):
        """Elements that stay; the text of the others is blanked in place. JSON-LD is handed back."""
        jsonld, kept, upto = [], [], -1
        for e in elements:
            if e.index <= upto:
                continue
            data = e.tag == "script" and e.attrs.get("type") == "application/ld+json"
            if data:
                jsonld.append("".join(texts[e.start:e.end]).strip())
            elif e.tag not in UNREAD and not (drop and drop(e)):
                kept.append(e)
                continue
            for i in range(e.start, e.end):
                texts[i] = ""
            upto = e.last
        return kept, jsonld

    def main_area(self, elements, tagged, text, selectors):
        for selector in selectors:
            for e in elements:
                if selector(e):
                    if not self.largest or len(text(e)) > 100:
                        return e
                    break
        if self.largest:
            best, size = None, 200
            for e in tagged.get("div", ()):
                if len(text(e)) > size:
                    best, size = e, len(text(e))
            if best is not None:
                return best
        return next(iter(tagged.get("body", ())), None)

    def __call__(self, html):
        elements, texts, seen = read(html, self.known, self.steps.mark)
        drop, main, pagers, articles, flags, custom = self.meets(seen)

        def by_tag(elements):
            out = {}
            for e in elements:
                if e.tag in out:
                    out[e.tag].append(e)
                else:
                    out[e.tag] = [e]
            return out

        tagged, jsonld, order = by_tag(elements), [], None
        title_raw = next(iter(tagged.get("title", ())), None)
        title = "".join(texts[title_raw.start:title_raw.end]).strip() if title_raw else None
        if drop or not UNREAD.isdisjoint(tagged):
            elements, jsonld = self.remove(elements, texts, drop)
            tagged, order = by_tag(elements), [e.index for e in elements]

        def text(e):
            start, end = e.start, e.end
            return (texts[start] if end - start == 1 else "".join(texts[start:end])).strip()

        def between(first, last):
            # without gaps an element stands at its index
            if order is None:
                return elements[first + 1:last + 1]
            return elements[bisect_right(order, first):bisect_right(order, last)]

        def inside(e, *tags):
            return [x for x in between(e.index, e.last) if x.tag in tags]

        area = self.main_area(elements, tagged, text, main)
        first, last = (area.index, area.last) if area else (-1, 10**12)
        pieces = texts[area.start:area.end] if area else texts

        def of(tag):
            return [e for e in tagged.get(tag, ()) if first < e.index <= last]

        def number(tag):
            return len(tagged.get(tag, ()))

        def rows(table):
            out = []
            for r in inside(table, "tr"):
                out.append([text(c) for c in inside(r, "td", "th")])
            return out

        tables = []
        for t in of("table"):
            grid = rows(t)
            if not grid:
                continue
            caption = next((text(c) for c in inside(t, "caption")), None)
            body = [r for r in grid[1:] if r]
            if body:
                tables.append({"caption": caption, "headers": grid[0], "rows": body})
        html_tag = next(iter(tagged.get("html", ())), None)
        canonical = next((e.attrs["href"] for e in tagged.get("link", ()) if "canonical" in e.attrs.get("rel", "").split() and e.attrs.get("href")), None)

        def anchor(e):
            a = e.attrs
            return {"href": a["href"], "text": text(e), "title": a.get("title"), "rel": a.get("rel"), "target": a.get("target"),
                    "in_main": first <= e.index <= last, "pager": pagers is not None and pagers(e), "article": articles is not None and articles(e)}

        def image(e):
            a = e.attrs
            return {"src": a.get("src"), "data_src": a.get("data-src"), "alt": a.get("alt", ""), "title": a.get("title"),
                    "width": a.get("width"), "height": a.get("height"), "class": a.get("class"), "loading": a.get("loading"),
                    "in_main": first <= e.index <= last}

        return {
            "title": title,
            "html_lang": (html_tag.attrs.get("lang") or html_tag.attrs.get("xml:lang")) if html_tag else None,
            "canonical": canonical,
            "metas": [{"name": e.attrs.get("name", "").lower(), "property": e.attrs.get("property", "").lower(), "content": e.attrs.get("content", "")}
                      for e in tagged.get("meta", ())],
            "jsonld": jsonld,
            "text": " ".join(" ".join(pieces).split()),
            "headings": [{"level": n, "text": text(e), "id": e.attrs.get("id"), "class": e.attrs.get("class")}
                         for n, tag in HEADINGS if tag in tagged for e in of(tag)],
            "paragraphs": [text(e) for e in of("p")],
            "blocks": [text(e) for e in between(first, last) if e.tag in ("div", "span", "section")] if self.largest else [],
            "lists": [x for x in ({"type": e.tag, "items": [text(li) for li in inside(e, "li")]} for e in between(first, last) if e.tag in ("ul", "ol")) if x["items"]] if "li" in tagged else [],
            "tables": tables,
            "element_counts": [(k, len(v)) for k, v in tagged.items() if k in COUNTED],
            "media_count": sum(map(number, ("img", "video", "audio", "iframe"))),
            "form_count": number("form"),
            **{name: bool(s) and any(map(s, elements)) for name, s in flags},
            "anchors": [anchor(e) for e in tagged.get("a", ()) if "href" in e.attrs],
            "images": [image(e) for e in tagged.get("img", ())],
            "forms": [{"action": e.attrs.get("action", ""), "method": (e.attrs.get("method") or "GET").upper(),
                       "fields": [{"name": f.attrs.get("name", ""), "type": f.attrs.get("type", "text"), "required": "required" in f.attrs}
                                  for f in inside(e, "input", "textarea", "select")]}
                      for e in tagged.get("form", ())],
            "custom": [(name, [text(e) for e in elements if s(e)] if name in custom else []) for name, s in self.custom.items()],
            "error": None,
        }


EMPTY = {
    "title": None, "html_lang": None, "canonical": None, "metas": [], "jsonld": [], "text": "", "headings": [], "paragraphs": [],
    "blocks": [], "lists": [], "tables": [], "element_counts": [], "media_count": 0, "form_count": 0, "has_navigation": False,
    "has_sidebar": False, "has_footer": False, "anchors": [], "images": [], "forms": [], "custom": [],
}


def failed(message):
    return {**EMPTY, "error": message}
