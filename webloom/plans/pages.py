"""Extraction queries: over the stored pages, and over pages rendered from the other tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.operators import pages as X
from webloom.plans.cleaning import strip_sql
from webloom.plans.registry import query

WS = r"[\s\x0b\x{85}\p{Z}]"


def un(x):
    return f"replace(replace(replace(replace({x}, '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


ART = "regexp_extract(raw_html, '(?s)<article>(.*?)</article>', 1)"
PARTS = f"""
a AS (SELECT page_id, url, host, raw_html, {un("regexp_extract(raw_html, '<title>([^<]*)</title>', 1)")} AS title_raw, {ART} AS art FROM v_pages),
p AS (SELECT page_id, unnest((string_split(art, '<p>'))[2:]) AS seg, generate_subscripts((string_split(art, '<p>'))[2:], 1) AS pos FROM a),
pt AS (SELECT page_id, pos, {strip_sql(un("regexp_replace(split_part(seg, '</p>', 1), '<[^>]*>', '', 'g')"))} AS text FROM p),
ln AS (SELECT page_id, url AS page_url, unnest(regexp_extract_all(raw_html, '<a href="([^"]*)">', 1)) AS href, unnest(regexp_extract_all(raw_html, '<a href="[^"]*">([^<]*)</a>', 1)) AS text FROM v_pages),
tx AS (SELECT page_id, trim(regexp_replace({un("regexp_replace(art, '<[^>]*>', ' ', 'g')")}, '{WS}+', ' ', 'g')) AS text FROM a)
"""


def parts(t):
    return X.extract_pages(t.pages().withColumn("bytes", F.octet_length("raw_html")))


@query("x1_page_extract", f"""WITH {PARTS} SELECT page_id, {strip_sql('title_raw')} AS title, regexp_extract(raw_html, '<html lang="([^"]*)"', 1) AS lang, CAST(NULL AS STRING) AS error FROM a""", ["v_pages"])
def x1(t):
    return parts(t).select("page_id", "title", F.col("html_lang").alias("lang"), "error")


@query("x2_boilerplate_free_text", f"WITH {PARTS} SELECT page_id, text FROM tx", ["v_pages"])
def x2(t):
    return parts(t).select("page_id", "text")


@query("x5_best_title", f"WITH {PARTS} SELECT page_id, {strip_sql('title_raw')} AS title FROM a", ["v_pages"])
def x5(t):
    return parts(t).select("page_id", X.best_title().alias("title"))


@query("x6_largest_area", f"""
WITH {PARTS}, big AS (SELECT page_id, {strip_sql(un("regexp_replace(art, '<[^>]*>', '', 'g')"))} AS t FROM a)
SELECT tx.page_id, CASE WHEN length(t) > 100 THEN tx.text ELSE trim(regexp_replace({un("regexp_replace(art, '<[^>]*>', ' ', 'g')")}, '{WS}+', ' ', 'g')) END AS text FROM tx JOIN big USING (page_id) JOIN a USING (page_id)""", ["v_pages"])
def x6(t):
    return X.extract_pages(t.pages(), main="largest").select("page_id", "text")


@query("x7_headings", f"WITH {PARTS} SELECT page_id, 0 AS pos, 1 AS level, {strip_sql(un(chr(34).join(['regexp_extract(art, ' + chr(39) + '<h1>([^<]*)</h1>' + chr(39) + ', 1)'])))} AS text FROM a", ["v_pages"])
def x7(t):
    return X.headings(parts(t)).select("page_id", "pos", "level", "text")


@query("x8_paragraphs", f"WITH {PARTS} SELECT page_id, text FROM pt WHERE length(text) > 10", ["v_pages"])
def x8(t):
    return X.paragraphs(parts(t)).select("page_id", "text")


LET = "length(regexp_replace(text, '\\P{L}+', '', 'g'))"
BODY = f"""bd AS (SELECT page_id, string_agg(text, ' ' ORDER BY pos) AS text FROM pt WHERE length(text) > 20 AND {LET} > length(text) * 0.5
 AND NOT regexp_matches(lower(text), '^(click|subscribe|follow|share)') GROUP BY page_id)"""


@query("x8_body_text", f"WITH {PARTS}, {BODY} SELECT a.page_id, coalesce(bd.text, '') AS text FROM a LEFT JOIN bd USING (page_id)", ["v_pages"])
def x8b(t):
    return parts(t).select("page_id", X.body_text().alias("text"))


@query("x12_tag_totals", """
SELECT tag, CAST(sum(n) AS BIGINT) AS elements, count(*) AS pages FROM (
 SELECT page_id, t.tag AS tag, len(regexp_extract_all(regexp_replace(regexp_replace(raw_html, '(?s)<script>.*?</script>', ''), '(?s)<div class="ad">.*?</div>', ''), concat('<', t.tag, '[ >]'))) AS n
 FROM v_pages, (VALUES ('div'), ('p'), ('a'), ('h1'), ('ul'), ('li')) t(tag)) WHERE n > 0 GROUP BY tag""", ["v_pages"])
def x12(t):
    return X.tag_counts(parts(t))


@query("x12_page_profile", "SELECT page_id, true AS has_navigation, false AS has_sidebar, true AS has_footer, 0 AS form_count, 0 AS media_count FROM v_pages", ["v_pages"])
def x12b(t):
    return parts(t).select("page_id", "has_navigation", "has_sidebar", "has_footer", "form_count", "media_count")


@query("x13_links", f"""
WITH {PARTS} SELECT page_id, concat(regexp_extract(page_url, '^(https?://[^/]+)', 1), {un('href')}) AS url, {strip_sql(un('text'))} AS text, false AS is_external FROM ln""", ["v_pages"])
def x13(t):
    return X.links(parts(t)).select("page_id", "url", "text", "is_external")


@query("x16_navigation", f"WITH {PARTS} SELECT page_id, {un('href')} AS url, {strip_sql(un('text'))} AS text, 1 AS level FROM ln WHERE {strip_sql(un('text'))} <> ''", ["v_pages"])
def x16(t):
    return X.navigation(parts(t)).select("page_id", "url", "text", "level")


@query("x18_fallback", f"""
WITH {PARTS}, k AS (SELECT page_id, page_id % 3 = 0 AS plain FROM pages)
SELECT page_id, 'text' AS content_type, substr(raw_html, 1, 1000) AS content, CAST(length(raw_html) AS INT) AS length, CAST(NULL AS STRING) AS title, CAST(NULL AS INT) AS n_paragraphs, CAST(NULL AS INT) AS n_links, 0.5::DOUBLE AS confidence FROM v_pages JOIN k USING (page_id) WHERE plain
UNION ALL SELECT a.page_id, 'html', NULL, NULL, {strip_sql('title_raw')}, CAST((SELECT count(*) FROM pt WHERE pt.page_id = a.page_id) AS INT), CAST(len(regexp_extract_all(raw_html, '<a ')) AS INT), 0.5 FROM a JOIN k USING (page_id) WHERE NOT plain""", ["v_pages"])
def x18(t):
    typed = t.pages().withColumn("content_type", F.when(F.col("page_id") % 3 == 0, "text").otherwise("html"))
    found = X.fallback(typed, X.extract_pages(typed.where("content_type = 'html'").drop("content_type")))
    return found.select("page_id", "content_type", "content", "length", "title", "n_paragraphs", "n_links", "confidence")


SIZE = "CASE WHEN length(tx.text) > 100 THEN 0.3 WHEN length(tx.text) > 50 THEN 0.15 ELSE 0 END"


@query("x21_page_confidence", f"""
WITH {PARTS} SELECT a.page_id, round((CASE WHEN {strip_sql('title_raw')} <> '' THEN 0.2 ELSE 0 END + {SIZE} + 0.2 + CASE WHEN art LIKE '%<p>%' THEN 0.15 ELSE 0 END)::DOUBLE, 6) AS confidence FROM a JOIN tx USING (page_id)""", ["v_pages"])
def x21(t):
    return parts(t).select("page_id", F.round(X.page_confidence(), 6).alias("confidence"))


QUALITY = f"""ql AS (SELECT a.page_id, a.host, least(1.0, (CASE WHEN length({strip_sql('title_raw')}) > 5 THEN 0.15 + CASE WHEN length({strip_sql('title_raw')}) > 20 AND length({strip_sql('title_raw')}) < 100 THEN 0.05 ELSE 0 END ELSE 0 END
 + CASE WHEN n > 1000 THEN 0.4 WHEN n > 500 THEN 0.3 WHEN n > 100 THEN 0.2 ELSE 0 END + 0.1 + CASE WHEN raw_html LIKE '%<a %' THEN 0.05 ELSE 0 END + 0.05 + CASE WHEN strlen(raw_html) > 5000 THEN 0.05 ELSE 0 END)::DOUBLE) AS quality
 FROM a JOIN (SELECT a.page_id, coalesce(length(bd.text), 0) AS n FROM a LEFT JOIN bd USING (page_id)) b USING (page_id))"""


def _quality():
    return X.page_quality(X.best_title(), X.body_text(), F.size("headings"), F.size("anchors"), F.size("images"), F.lit(200), F.col("bytes"))


@query("x22_page_quality", f"WITH {PARTS}, {BODY}, {QUALITY} SELECT page_id, round(quality, 6) AS quality FROM ql", ["v_pages"])
def x22(t):
    return parts(t).select("page_id", F.round(_quality(), 6).alias("quality"))


@query("host_overview", f"""
WITH {PARTS}, {BODY}, {QUALITY},
dup AS (SELECT a.page_id, row_number() OVER (PARTITION BY {strip_sql('title_raw')}, tx.text ORDER BY a.page_id) > 1 AS d FROM a JOIN tx USING (page_id))
SELECT host, count(*) AS pages, round(avg(quality), 6) AS avg_quality, round(avg(d::INT::DOUBLE), 6) AS duplicate_share, CAST(0 AS BIGINT) AS outbound_links FROM ql JOIN dup USING (page_id) GROUP BY host""", ["v_pages"])
def overview(t):
    out = X.host_overview(parts(t))
    return out.withColumns({"avg_quality": F.round("avg_quality", 6), "duplicate_share": F.round("duplicate_share", 6)})


# --- pages rendered from tables: extraction gives the table back ------------------------------

def _tag(name, *inner, attrs=""):
    return F.concat(F.lit(f"<{name}{attrs}>"), *inner, F.lit(f"</{name}>"))


def _page(df, body, head=None, url="https://site.example.com/dir/page.html"):
    html = F.concat(F.lit("<!doctype html><html lang='de'><head>"), head if head is not None else F.lit(""),
                    F.lit("</head><body><main>"), body, F.lit("</main></body></html>"))
    return df.select("page_id", F.lit(url).alias("url"), html.alias("raw_html"))


def cell_pages(t):
    """A page per part with a table of its name and type."""
    p = t["part"].withColumnRenamed("p_partkey", "page_id")
    html = F.concat(
        F.lit("<table><caption> "), "p_brand", F.lit("</caption><tr><th>field<th>value</tr><tr><td>name<td> "), "p_name",
        F.lit(" </td><tr><td><b>type</b></td><td>"), "p_type", F.lit("</table><table><tr><td>no rows</table>"))
    return _page(p, html)


@query("x11_table_cells", """
SELECT p_partkey AS page_id, p_brand AS caption, CAST(x.i AS INT) AS row, CASE x.j WHEN 0 THEN 'field' ELSE 'value' END AS header,
 CASE WHEN x.j = 0 THEN CASE x.i WHEN 0 THEN 'name' ELSE 'type' END WHEN x.i = 0 THEN p_name ELSE p_type END AS value FROM part, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) x(i, j)""")
def x11(t):
    return X.table_cells(X.extract_pages(cell_pages(t))).select("page_id", "caption", "row", "header", "value")


@query("x10_list_items", "SELECT p_partkey AS page_id, 'ol' AS type, CAST(x.i AS INT) AS item, CASE x.i WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE p_type END AS text FROM part, (VALUES (0), (1), (2)) x(i)")
def x10(t):
    p = t["part"].withColumnRenamed("p_partkey", "page_id")
    html = F.concat(F.lit("<ol><li> "), "p_name", F.lit("<li>"), "p_brand", F.lit("</li><li><b>"), "p_type", F.lit("</ol>"))
    return X.list_items(X.extract_pages(_page(p, html))).select("page_id", "type", "item", "text")


@query("x3_page_metadata", """
SELECT c_custkey AS page_id, c_name AS title, concat('About ', c_name) AS description, concat(c_mktsegment, '|customer') AS keywords, 'de' AS language,
 concat('https://site.example.com/c/', CAST(c_custkey AS STRING)) AS canonical_url, c_mktsegment AS og_type, 'summary' AS twitter_card FROM customer""")
def x3(t):
    c = t["customer"].withColumnRenamed("c_custkey", "page_id")
    head = F.concat(
        _tag("title", F.lit(" "), "c_name", F.lit(" ")), F.lit('<META NAME="Description" content="About '), "c_name",
        F.lit('"><meta name=keywords content="'), "c_mktsegment", F.lit(' , customer"><meta name="author" content=""><meta property="og:type" content="old">'),
        F.lit('<meta property="og:type" content=\''), "c_mktsegment", F.lit('\'><meta name="twitter:card" content="summary"><link rel=canonical href="../c/'),
        F.col("page_id").cast("string"), F.lit('">'))
    m = X.metadata(X.extract_pages(_page(c, F.lit("x"), head)))
    return m.select("page_id", "title", "description", F.array_join("keywords", "|").alias("keywords"), "language", "canonical_url",
                    F.col("og")["type"].alias("og_type"), F.col("twitter")["card"].alias("twitter_card"))


@query("x4_json_ld", """SELECT s_suppkey AS page_id, concat('{"@type":"Organization","name":"', s_name, '"}') AS block FROM supplier WHERE s_suppkey % 7 <> 0""")
def x4(t):
    s = t["supplier"].withColumnRenamed("s_suppkey", "page_id")
    body = F.concat(F.lit('{"@type":"Organization","name":"'), "s_name", F.when(F.col("page_id") % 7 == 0, '"').otherwise('"}'))
    head = F.concat(F.lit('<script>var a = "<p>no</p>";</script><script type="application/ld+json"> '), body, F.lit("\n</script>"))
    found = X.metadata(X.extract_pages(_page(s, F.lit("x"), head)))
    return found.select("page_id", F.explode("schema_data").alias("block"))


@query("x13_main_links", """
SELECT o_orderkey AS page_id, concat('https://site.example.com/o/', CAST(o_orderkey AS STRING)) AS url, o_orderpriority AS text, false AS is_external FROM orders
UNION ALL SELECT o_orderkey, concat('https://other.example.com/', CAST(o_custkey AS STRING)), 'customer', true FROM orders
UNION ALL SELECT o_orderkey, 'https://site.example.com/dir/page.html?page=2', 'next', false FROM orders""")
def x13b(t):
    o = t["orders"].withColumnRenamed("o_orderkey", "page_id")
    key = F.col("page_id").cast("string")
    html = F.concat(
        F.lit("<p><a href='/o/"), key, F.lit("'>"), "o_orderpriority", F.lit("</a><a href='/o/"), key, F.lit("'>again</a><a href=\"//other.example.com/"),
        F.col("o_custkey").cast("string"), F.lit("\">customer</a><a href=?page=2>next</a><a href='#top'>top of page</a><a href='mailto:a@b.c'>mail</a><a href='/q'>?</a>"))
    return X.links(X.extract_pages(_page(o, html)), "main").select("page_id", "url", "text", "is_external")


@query("x16_media", """
SELECT p_partkey AS page_id, CAST(0 AS INT) AS pos, 'image' AS type, concat('/img/', CAST(p_partkey AS STRING), '.png') AS src, p_name AS alt FROM part
UNION ALL SELECT p_partkey, 1, 'image', '', p_brand FROM part""")
def x16b(t):
    p = t["part"].withColumnRenamed("p_partkey", "page_id")
    html = F.concat(F.lit("<img src='/img/"), F.col("page_id").cast("string"), F.lit(".png' alt='"), "p_name", F.lit("'><p>text<img alt='"), "p_brand", F.lit("'></p>"))
    return X.media(X.extract_pages(_page(p, html)))


@query("x14_images", """
SELECT p_partkey AS page_id, concat('https://site.example.com/img/', CAST(p_partkey AS STRING), '.png') AS url, p_name AS alt, CAST(p_size AS STRING) AS width FROM part
UNION ALL SELECT p_partkey, concat('https://site.example.com/dir/lazy-', CAST(p_partkey AS STRING), '.png'), '', NULL FROM part""")
def x14(t):
    p = t["part"].withColumnRenamed("p_partkey", "page_id")
    key = F.col("page_id").cast("string")
    img = F.concat(F.lit("<img src='/img/"), key, F.lit(".png' alt='"), "p_name", F.lit("' width="), F.col("p_size").cast("string"), F.lit(">"))
    html = F.concat(img, img, F.lit("<img data-src='lazy-"), key, F.lit(".png'><img>"))
    return X.images(X.extract_pages(_page(p, html)), "main").select("page_id", "url", "alt", "width")


@query("x15_form_fields", """
SELECT c_custkey AS page_id, concat('/save/', CAST(c_custkey AS STRING)) AS action, 'POST' AS method, 'name' AS name, 'text' AS type, true AS required FROM customer
UNION ALL SELECT c_custkey, concat('/save/', CAST(c_custkey AS STRING)), 'POST', lower(c_mktsegment), 'hidden', false FROM customer""")
def x15(t):
    c = t["customer"].withColumnRenamed("c_custkey", "page_id")
    html = F.concat(F.lit("<form action='/save/"), F.col("page_id").cast("string"), F.lit("' method=post><input name=name required><input type=hidden name='"),
                    F.lower("c_mktsegment"), F.lit("'/></form>"))
    return X.form_fields(X.extract_pages(_page(c, html))).select("page_id", "action", "method", "name", "type", "required")


@query("x17_custom_selectors", """
SELECT p_partkey AS page_id, 'title' AS name, 0 AS pos, p_name AS text FROM part UNION ALL SELECT p_partkey, 'price', 0, concat('$', CAST(p_retailprice AS STRING)) FROM part
UNION ALL SELECT p_partkey, 'price', 1, p_brand FROM part""")
def x17(t):
    p = t["part"].withColumnRenamed("p_partkey", "page_id")
    html = F.concat(F.lit("<div class='box product-title big'>"), "p_name", F.lit("</div><p class=price>$"), F.col("p_retailprice").cast("string"),
                    F.lit("<section id=more><span data-kind='old price'> "), "p_brand", F.lit(" </span></section><span class=cost-x>no</span>"))
    wanted = {"title": ".product-title, h1", "price": ".price, .cost, #more span[data-kind*=price]", "none": ".product-description"}
    return X.custom_values(X.extract_pages(_page(p, html), custom=wanted))


@query("m2_exclude_selectors", f"""
WITH {PARTS} SELECT page_id, trim(regexp_replace({un("regexp_replace(regexp_replace(art, '(?s)<h1>.*?</h1>', ''), '<[^>]*>', ' ', 'g')")}, '{WS}+', ' ', 'g')) AS text, 0 AS links FROM a""", ["v_pages"])
def m2(t):
    found = X.extract_pages(t.pages(), exclude=["nav ul", "article h1"])
    return found.select("page_id", "text", F.size("anchors").alias("links"))


@query("h7_element_caps", "SELECT p_partkey AS page_id, CAST(least(p_size, 20) AS INT) AS links, CAST(least(p_size, 10) AS INT) AS images FROM part")
def h7(t):
    p = t["part"].withColumnRenamed("p_partkey", "page_id")
    numbers = F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda n: n.cast("string"))
    html = F.concat(
        F.array_join(F.transform(numbers, lambda n: F.concat(F.lit("<a href='/o/"), n, F.lit("'>order "), n, F.lit("</a>"))), ""),
        F.array_join(F.transform(numbers, lambda n: F.concat(F.lit("<img src='/i/"), n, F.lit(".png'>"))), ""))
    found = X.extract_pages(_page(p, html))
    return found.select("page_id", X.main_links().alias("links"), X.main_images().alias("images")).select("page_id", F.size("links").alias("links"), F.size("images").alias("images"))
