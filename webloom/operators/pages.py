"""Page extraction: one pass of Python over the stored pages, everything after it in Spark."""

from __future__ import annotations

import gc
from collections.abc import Iterator, Mapping, Sequence
from itertools import accumulate, chain
from operator import itemgetter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from webloom.functions.cleaning import content_hash, letters, strip
from webloom.functions.common import all_of, any_of, let, total
from webloom.functions.markup import PageReader, failed
from webloom.functions.text import entities
from webloom.functions.urls import host, is_external, is_page_link, leaves_host, resolve
from webloom.session import spread

# Page furniture that is never content, the wider list of the second strategy, and
# where the main area is looked for.
UNWANTED = (
    ".advertisement", ".ad", ".ads", ".cookie-banner", ".cookie-notice", ".popup", ".modal", ".social-share",
    ".share-buttons", ".newsletter-signup", '[style*="display: none"]', '[style*="visibility: hidden"]',
)
UNWANTED_WIDE = (
    "script", "style", "nav", "header", "footer", "aside", ".advertisement", ".ad", ".ads", ".cookie-banner", ".popup",
    ".social-share", ".share-buttons", ".newsletter-signup",
)
MAIN = (
    "main", "article", '[role="main"]', ".main-content", ".content", ".post-content", ".entry-content", "#main", "#content",
)
MAIN_WIDE = (
    "main", "article", '[role="main"]', ".main-content", ".content", ".post-content", ".entry-content",
    ".article-content", "#main", "#content", "#post",
)
NOT_PROSE = ("click", "subscribe", "follow", "share")


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()
_L = T.ArrayType
EXTRACT = _struct(
    title=_S, html_lang=_S, canonical=_S,
    metas=_L(_struct(name=_S, property=_S, content=_S)),
    jsonld=_L(_S), text=_S,
    headings=_L(_struct(level=_I, text=_S, id=_S, **{"class": _S})),
    paragraphs=_L(_S), blocks=_L(_S),
    lists=_L(_struct(type=_S, items=_L(_S))),
    tables=_L(_struct(caption=_S, headers=_L(_S), rows=_L(_L(_S)))),
    element_counts=T.MapType(_S, _I), media_count=_I, form_count=_I,
    has_navigation=_B, has_sidebar=_B, has_footer=_B,
    anchors=_L(_struct(href=_S, text=_S, title=_S, rel=_S, target=_S, in_main=_B, pager=_B, article=_B)),
    images=_L(_struct(src=_S, data_src=_S, alt=_S, title=_S, width=_S, height=_S, **{"class": _S}, loading=_S, in_main=_B)),
    forms=_L(_struct(action=_S, method=_S, fields=_L(_struct(name=_S, type=_S, required=_B)))),
    custom=T.MapType(_S, _L(_S)), error=_S,
)


#: A worker holds the parts of so many pages, and of so many bytes of HTML, at once.
PORTION_ROWS, PORTION_BYTES = 200, 1_000_000


def portions(html: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, number) of rows that are read together; a page larger than a portion is one by itself."""
    sizes = pc.fill_null(pc.binary_length(html), 0).to_pylist()
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if i > first and (i - first >= PORTION_ROWS or held + size > PORTION_BYTES):
            yield first, i - first
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield first, len(sizes) - first


def column(values: list, kind: pa.DataType) -> pa.Array:
    """Arrow array of Python values. Lists and structs are laid out flat first, so that Arrow is given plain values only."""
    if pa.types.is_list(kind):
        ends = pa.array(accumulate(map(len, values), initial=0), pa.int32())
        return pa.ListArray.from_arrays(ends, column(list(chain.from_iterable(values)), kind.value_type), type=kind)
    if pa.types.is_struct(kind) and values:
        return pa.StructArray.from_arrays([column(list(map(itemgetter(f.name), values)), f.type) for f in kind], fields=list(kind))
    return pa.array(values, type=kind)


def extract_pages(
    pages: DataFrame, *, exclude: Sequence[str] = (), custom: Mapping[str, str] | None = None, main: str = "priority",
    html: str = "raw_html",
) -> DataFrame:
    """All parts of every page; a page that cannot be read keeps its row with ``error`` set.

    ``main`` is "priority" (first known container) or "largest" (first container with more than
    100 characters, else the largest div), which also drops navigation, header and footer. All
    other columns are handed through. Pages of a file with few splits are spread over the cluster
    first, since reading a page costs far more than moving it. The parts of pages weigh many times
    their HTML in Python, so they are given back by ``portions``, however many rows a batch has.
    """
    keep = [c for c in pages.columns if c != html]
    wide = main == "largest"
    drop = [*exclude, *UNWANTED, *(UNWANTED_WIDE if wide else ())]
    containers = MAIN_WIDE if wide else MAIN
    selectors = dict(custom or {})
    schema = T.StructType([pages.schema[c] for c in keep] + EXTRACT.fields)
    arrow = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = PageReader(drop, containers, selectors, main)

        def parts(text: str | None) -> dict:
            try:
                return failed("no content") if text is None else reader(text)
            except Exception as fault:  # a page must never stop the job
                return failed(f"{type(fault).__name__}: {fault}")

        for whole in batches:
            for first, number in portions(whole.column(html)):
                batch = whole.slice(first, number)
                gc.disable()  # a page leaves no cycles behind, and looking for them costs a third of the time
                try:
                    found = list(map(parts, batch.column(html).to_pylist()))
                    columns = [batch.column(c) for c in keep]
                    columns.extend(column(list(map(itemgetter(f.name), found)), arrow.field(f.name).type) for f in EXTRACT)
                    del found
                finally:
                    gc.enable()
                yield pa.RecordBatch.from_arrays([c.cast(arrow.field(i).type) for i, c in enumerate(columns)], schema=arrow)

    return spread(pages.select(*keep, html)).mapInArrow(read, schema)


# --- metadata ------------------------------------------------------------------------------

def _last(items: Column, test) -> Column:
    return F.try_element_at(F.filter(items, test), F.lit(-1))


def meta(name: str) -> Column:
    """Content of the last non-empty meta tag of that name."""
    return _last(F.col("metas"), lambda m: (m["name"] == name) & (m["content"] != ""))["content"]


def _prefixed(field: str, prefix: str, others: Sequence[str] = ()) -> Column:
    found = F.filter(F.col("metas"), lambda m: (m["content"] != "") & m[field].startswith(prefix)
                     & ~m["name"].isin("description", "keywords", "author", "language", *others))
    keys = F.array_distinct(F.transform(found, lambda m: m[field]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(
        F.substr(k, F.lit(len(prefix) + 1)).alias("key"), _last(found, lambda m: m[field] == k)["content"].alias("value"))))


def metadata(extracts: DataFrame, url: str = "url") -> DataFrame:
    return extracts.select(
        "page_id", url, "title", meta("description").alias("description"),
        F.transform(F.split(meta("keywords"), ","), strip).alias("keywords"),
        meta("author").alias("author"), F.coalesce(meta("language"), F.nullif("html_lang", F.lit(""))).alias("language"),
        F.when(F.col("canonical").isNotNull(), resolve(F.col(url), F.col("canonical"))).alias("canonical_url"),
        _prefixed("property", "og:").alias("og"), _prefixed("name", "twitter:").alias("twitter"),
        structured_data("jsonld").alias("schema_data"),
    )


def structured_data(blocks: Column | str) -> Column:
    """JSON-LD blocks that parse, as text."""
    return F.filter(F.col(blocks) if isinstance(blocks, str) else blocks, lambda b: F.try_parse_json(b).isNotNull())


def best_title() -> Column:
    """Title, else og:title, else the first h1, else ''."""
    og = F.try_element_at(F.filter("metas", lambda m: (m["property"] == "og:title") & (m["content"] != "")), F.lit(1))["content"]
    h1 = F.try_element_at(F.filter("headings", lambda h: h["level"] == 1), F.lit(1))["text"]
    return F.coalesce(*[F.nullif(strip(v), F.lit("")) for v in (F.col("title"), og, h1)], F.lit(""))


# --- content -------------------------------------------------------------------------------

def paragraphs(extracts: DataFrame) -> DataFrame:
    """Paragraphs of more than 10 characters, in order."""
    rows = extracts.select("page_id", F.posexplode(F.filter("paragraphs", lambda p: F.length(p) > 10)).alias("pos", "text"))
    return rows


def is_prose(text: Column) -> Column:
    return all_of([
        F.length(text) > 20, ~any_of(F.lower(text).startswith(w) for w in NOT_PROSE), letters(text) > F.length(text) * 0.5])


def body_text() -> Column:
    """Prose paragraphs joined; without any, up to five blocks of 51 to 999 characters."""
    prose = F.filter("paragraphs", is_prose)
    blocks = F.slice(F.filter("blocks", lambda b: (F.length(b) > 50) & (F.length(b) < 1000)), 1, 5)
    return F.array_join(F.when(F.size(prose) > 0, prose).otherwise(blocks), " ")


def headings(extracts: DataFrame, min_chars: int = 0) -> DataFrame:
    kept = F.filter("headings", lambda h: F.length(h["text"]) > min_chars) if min_chars else F.col("headings")
    return extracts.select("page_id", F.posexplode(kept).alias("pos", "h")).select("page_id", "pos", "h.*")


def list_items(extracts: DataFrame) -> DataFrame:
    lists = extracts.select("page_id", F.posexplode("lists").alias("list", "l"))
    return lists.select("page_id", "list", "l.type", F.posexplode("l.items").alias("item", "text"))


def table_cells(extracts: DataFrame) -> DataFrame:
    """(page, table, caption, row, col, header, value) of every data cell."""
    tables = extracts.select("page_id", F.posexplode("tables").alias("table", "t"))
    rows = tables.select("page_id", "table", "t.caption", "t.headers", F.posexplode("t.rows").alias("row", "cells"))
    cells = rows.select("page_id", "table", "caption", "headers", "row", F.posexplode("cells").alias("col", "value"))
    return cells.select("page_id", "table", "caption", "row", "col", F.get("headers", "col").alias("header"), "value")


def tag_counts(extracts: DataFrame) -> DataFrame:
    rows = extracts.select(F.explode("element_counts").alias("tag", "n"))
    return rows.groupBy("tag").agg(F.sum("n").alias("elements"), F.count(F.lit(1)).alias("pages"))


def links(extracts: DataFrame, variant: str = "all", url: str = "url") -> DataFrame:
    """Links to pages as absolute URLs. ``variant="main"``: of the main area, once per target, with
    more than two characters of text, at most 20 per page."""
    kept = F.filter("anchors", lambda a: is_page_link(a["href"]))
    if variant == "main":
        kept = main_links()
    rows = extracts.select("page_id", F.col(url).alias("page_url"), F.posexplode(kept).alias("pos", "a"))
    target = resolve(F.col("page_url"), F.col("a.href"))
    return rows.select("page_id", "page_url", "pos", target.alias("url"), "a.text", "a.title", "a.rel", "a.target", "a.pager", "a.article") \
        .withColumn("is_external", is_external("url", "page_url"))


def main_links(limit: int = 20) -> Column:
    """Anchors of the main area with a text, once per target."""
    named = F.filter("anchors", lambda a: is_page_link(a["href"]) & a["in_main"] & (F.length(a["text"]) > 2))
    return F.slice(first_of_each(named, "href"), 1, limit)


def main_images(limit: int = 10) -> Column:
    """Images of the main area, lazy sources included, once per source."""

    def source(i: Column) -> Column:
        return F.coalesce(F.nullif(strip(i["src"]), F.lit("")), F.nullif(strip(i["data_src"]), F.lit("")))

    with_src = F.transform(F.filter("images", lambda i: i["in_main"]), lambda i: i.withField("src", source(i)))
    return F.slice(first_of_each(F.filter(with_src, lambda i: i["src"].isNotNull()), "src"), 1, limit)


def first_of_each(items: Column, field: str) -> Column:
    """Items whose ``field`` has not occurred before in the array."""

    def pick(all_items: Column) -> Column:
        return let(F.transform(all_items, lambda x: strip(x[field])), lambda seen: F.filter(
            all_items, lambda x, i: F.array_position(seen, F.get(seen, i)) == i + 1))

    return let(items, pick)


def images(extracts: DataFrame, variant: str = "all", url: str = "url") -> DataFrame:
    """Images with absolute URLs. ``variant="main"``: lazy sources count, once each, at most 10 per page."""
    if variant == "main":
        kept = main_images()
    else:
        kept = F.filter("images", lambda i: F.coalesce(i["src"], F.lit("")) != "")
    rows = extracts.select("page_id", F.col(url).alias("page_url"), F.posexplode(kept).alias("pos", "i"))
    return rows.select("page_id", "pos", resolve(F.col("page_url"), F.col("i.src")).alias("url"), "i.alt", "i.title", "i.width", "i.height", "i.class", "i.loading")


def form_fields(extracts: DataFrame) -> DataFrame:
    forms = extracts.select("page_id", F.posexplode("forms").alias("form", "f"))
    return forms.select("page_id", "form", "f.action", "f.method", F.posexplode_outer("f.fields").alias("field", "x")) \
        .select("page_id", "form", "action", "method", "field", "x.name", "x.type", "x.required")


def navigation(extracts: DataFrame) -> DataFrame:
    kept = F.filter("anchors", lambda a: a["text"] != "")
    return extracts.select("page_id", F.posexplode(kept).alias("pos", "a")) \
        .select("page_id", "pos", "a.text", F.col("a.href").alias("url"), F.lit(1).alias("level"))


def media(extracts: DataFrame) -> DataFrame:
    return extracts.select("page_id", F.posexplode("images").alias("pos", "i")) \
        .select("page_id", "pos", F.lit("image").alias("type"), F.coalesce("i.src", F.lit("")).alias("src"), "i.alt")


def custom_values(extracts: DataFrame) -> DataFrame:
    """(page, name, pos, text) for every hit of a caller's selector."""
    named = extracts.select("page_id", F.explode("custom").alias("name", "texts"))
    return named.select("page_id", "name", F.posexplode("texts").alias("pos", "text"))


# --- scores --------------------------------------------------------------------------------

def page_confidence(compat: bool = False) -> Column:
    """Share of expected parts found. ``compat``: without the part for paragraphs, which then never counts."""
    size = F.length("text")
    has_p = F.coalesce(F.element_at("element_counts", "p"), F.lit(0)) > 0
    hits = F.exists(F.map_values("custom"), lambda v: F.size(v) > 0)
    parts = [
        F.when(F.coalesce("title", F.lit("")) != "", 0.2).otherwise(0.0),
        F.when(size > 100, 0.3).when(size > 50, 0.15).otherwise(0.0),
        F.when(F.size("headings") > 0, 0.2).otherwise(0.0),
        F.lit(0.0) if compat else F.when(has_p, 0.15).otherwise(0.0),
        F.when(hits, 0.15).otherwise(0.0),
    ]
    return F.least(total(parts), F.lit(1.0))


def page_quality(title: Column, text: Column, n_headings: Column, n_links: Column, n_images: Column, status: Column, size: Column) -> Column:
    def worth(test: Column, points: float) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), points).otherwise(0.0)

    named = F.length(strip(title)) > 5
    prose = let(F.length(strip(text)), lambda n: worth(n > 100, 0.2) + worth(n > 500, 0.1) + worth(n > 1000, 0.1))
    return F.least(F.lit(1.0), total([
        worth(named, 0.15), worth(named & (F.length(title) > 20) & (F.length(title) < 100), 0.05),
        prose,
        worth(n_headings > 0, 0.1), worth(n_headings > 2, 0.1), worth(n_links > 0, 0.05), worth(n_images > 0, 0.05),
        worth(status == 200, 0.05), worth(size > 5000, 0.05),
    ]))


def fallback(pages: DataFrame, extracts: DataFrame, content: str = "raw_html") -> DataFrame:
    """Structured data without an analyser: the parts of HTML pages, else the start of the content and its length.

    ``extracts`` holds the parts of the HTML pages only, so that other content never reaches the parser.
    """
    kind = F.col("content_type")
    parts = extracts.select(
        "page_id", F.coalesce("title", F.lit("")).alias("title"), F.size(F.filter("headings", lambda h: h["level"] <= 3)).alias("n_headings"),
        F.size("paragraphs").alias("n_paragraphs"), F.size("anchors").alias("n_links"), F.size("images").alias("n_images"),
        F.size(entities("text")).alias("n_entities"))
    other = pages.where(kind != "html").select(
        "page_id", kind.alias("content_type"), F.substring(content, 1, 1000).alias("content"), F.length(content).alias("length"))
    html = parts.withColumn("content_type", F.lit("html"))
    return html.unionByName(other, allowMissingColumns=True).withColumns(
        {"category": F.lit("web_content"), "confidence": F.lit(0.5)})


def host_overview(extracts: DataFrame) -> DataFrame:
    """Per host: pages, mean quality, share of pages that repeat an earlier one, links to other hosts.

    Pages are summed per (content, host) first. The first page of a content is a minimum over these
    sums, combined in each task before it moves, and joined back, so neither a content nor a host with
    very many pages meets in one task.
    """
    quality = page_quality(
        best_title(), body_text(), F.size("headings"), F.size("anchors"), F.size("images"), F.lit(200), F.col("bytes"))
    page_links = F.filter("anchors", lambda a: is_page_link(a["href"]))
    outbound = let(host("url"), lambda h: F.size(F.filter(page_links, lambda a: leaves_host(h, a["href"]))))
    per_page = extracts.select(
        "page_id", host("url").alias("host"), quality.alias("quality"), outbound.alias("outbound"),
        content_hash(title=F.col("title"), text=F.col("text")).alias("content"))
    sums = per_page.groupBy("content", "host").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("quality").alias("quality"), F.sum("outbound").alias("outbound"), F.min("page_id").alias("first"))
    originals = sums.groupBy("content").agg(F.min("first").alias("original"))
    # a page has one content, so the originals match their own sums only
    marked = sums.join(originals.select(F.col("original").alias("first"), F.lit(1).alias("original")), "first", "left")
    return marked.withColumn("original", F.coalesce("original", F.lit(0))).groupBy("host").agg(
        F.sum("pages").alias("pages"), (F.sum("quality") / F.sum("pages")).alias("avg_quality"),
        ((F.sum("pages") - F.sum("original")) / F.sum("pages")).alias("duplicate_share"), F.sum("outbound").alias("outbound_links"))
