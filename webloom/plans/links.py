"""Link, robots, politeness and crawl queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from webloom.operators import links as L
from webloom.operators import pages as X
from webloom.plans.pages import PARTS, _page, cell_pages, parts, un
from webloom.plans.registry import ORACLE, query

LINKS = f"lk AS (SELECT page_id, page_url, concat(regexp_extract(page_url, '^(https?://[^/]+)', 1), {un('href')}) AS url FROM ln)"


@query("e6_frontier_minus_seen", f"""
WITH {PARTS}, {LINKS}, seen AS (SELECT concat('https://', h, '/', w) AS url FROM (SELECT DISTINCT host AS h FROM v_pages) x, (VALUES ('de'), ('the'), ('in'), ('los')) y(w))
SELECT DISTINCT url FROM lk WHERE url NOT IN (SELECT url FROM seen)""", ["v_pages"])
def e6(t):
    found = X.links(parts(t)).select("url").distinct()
    words = F.explode(F.array(*[F.lit(w) for w in ("de", "the", "in", "los")]))
    seen = t.pages().select("host").distinct().select("host", words.alias("w")).select(F.concat(F.lit("https://"), "host", F.lit("/"), "w").alias("url"))
    return L.unseen(found, seen)


@query("e6_stored_seen", f"""
WITH {PARTS}, {LINKS}
SELECT DISTINCT url FROM lk WHERE url NOT IN (SELECT url FROM lk WHERE page_id % 3 = 0) AND url NOT IN (SELECT url FROM lk WHERE page_id % 3 = 1)""", ["v_pages"])
def e6b(t):
    """Links of a third round of pages that two earlier rounds, stored one after the other, did not have."""
    found = X.links(parts(t)).select("page_id", "url")
    seen = L.SeenTable(t.spark)
    seen.add(found.where("page_id % 3 = 0").select("url").distinct())
    seen.add(seen.unseen(found.where("page_id % 3 = 1").select("url").distinct()))
    return seen.unseen(found.select("url").distinct())


@query("x19_link_frontier", """
SELECT o_orderkey AS page_id, concat('https://site.example.com/list?page=', CAST(o_custkey AS STRING)) AS url, 1 AS rank FROM orders
UNION ALL SELECT o_orderkey, concat('https://site.example.com/next/', CAST(o_orderkey AS STRING)), 2 FROM orders
UNION ALL SELECT o_orderkey, concat('https://site.example.com/news/', CAST(o_orderkey AS STRING)), 3 FROM orders""")
def x19(t):
    o = t["orders"].withColumnRenamed("o_orderkey", "page_id")
    key, cust = F.col("page_id").cast("string"), F.col("o_custkey").cast("string")
    html = F.concat(
        F.lit("<a href='/news/"), key, F.lit("'>n</a><a href='/list?page="), cust, F.lit("'>p</a><a href='/news/"), key, F.lit("'>again</a>"),
        F.lit("<a href='/about'>a</a><a class=next href='/next/"), key, F.lit("'>&gt;</a><a href='https://other.example.com/news/1'>o</a>"))
    return L.frontier(X.links(X.extract_pages(_page(o, html, url="https://site.example.com/")))).select("page_id", "url", "rank")


@query("i3_link_union", """
SELECT o_orderkey AS page_id, concat_ws(' ', concat('/a/', CAST(o_orderkey % 7 AS STRING)), '/b', CASE WHEN o_orderkey % 7 <> 3 THEN '/a/3' END) AS links FROM orders""")
def i3(t):
    a = F.concat(F.lit("/a/"), (F.col("o_orderkey") % 7).cast("string"))
    union = L.pagination_union(F.array(a, F.lit("/b")), F.array(F.lit("/b"), F.lit("/a/3"), a))
    return t["orders"].select(F.col("o_orderkey").alias("page_id"), F.array_join(union, " ").alias("links"))


def _robots(t):
    hosts = t.pages().select("host").distinct()
    n = F.length("host") % 4
    text = (
        F.when(n == 0, "User-agent: *\nDisallow: /en/\nAllow: /\nCrawl-delay: 2.5\n")
        .when(n == 1, "# rules\nUser-agent: otherbot\nDisallow: /\n\nUser-agent: *\nAllow: /de/\nDisallow: /de\nRequest-rate: 1/5\n")
        .when(n == 2, "User-agent: loombot\nUser-agent: spare\nDisallow: /fr/\n\nUser-agent: *\nDisallow: /\n"))
    return hosts.select("host", text.alias("text")).where("text IS NOT NULL")


@query("e7_robots_permission", r"""
WITH u AS (SELECT page_id, host, length(host) % 4 AS n, regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS p FROM v_pages)
SELECT page_id, host, CASE n WHEN 0 THEN p NOT LIKE '/en/%' WHEN 1 THEN p LIKE '/de/%' OR p NOT LIKE '/de%' WHEN 2 THEN p NOT LIKE '/fr/%' ELSE true END AS allowed,
 CASE WHEN n = 0 AND p NOT LIKE '/en/%' THEN 2.5::DOUBLE END AS crawl_delay, CASE WHEN n = 1 AND (p LIKE '/de/%' OR p NOT LIKE '/de%') THEN '1/5' END AS request_rate,
 CASE WHEN n = 0 AND p NOT LIKE '/en/%' THEN 2.5 WHEN n = 1 AND (p LIKE '/de/%' OR p NOT LIKE '/de%') THEN 5.0 ELSE 1.0 END::DOUBLE AS recommended_delay FROM u""", ["v_pages"])
def e7(t):
    rules = L.robots_rules(t.spark, _robots(t))
    return L.robots_permission(t.pages().select("page_id", "url"), rules, "LoomBot/1.0").select(
        "page_id", "host", "allowed", "crawl_delay", "request_rate", "recommended_delay")


def _requests(t):
    return t["events"].select("event_id", "ts", F.concat(F.lit("h"), (F.col("user_id") % 5).cast("string")).alias("host"),
                              (F.lit(60.0) * (1 + F.col("user_id") % 5)).alias("delay"))


REQ = "WITH r AS (SELECT event_id, ts, concat('h', CAST(user_id % 5 AS STRING)) AS host, 60.0 * (1 + user_id % 5) AS delay FROM events)"


@query("g5_request_gaps", REQ + """
SELECT event_id, host, ((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY host ORDER BY ts, event_id))) / 1e6)::DOUBLE AS gap_seconds FROM r""")
def g5(t):
    return L.request_gaps(_requests(t), "ts", "event_id").select("event_id", "host", "gap_seconds")


@query("g8_politeness_schedule", REQ.replace("WITH r", "WITH r0").replace("60.0", "300.0") + """,
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts, event_id) AS k FROM r0),
m AS (SELECT *, max(epoch_us(ts) - k * CAST(delay * 1e6 AS BIGINT)) OVER (PARTITION BY host ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS m FROM r)
SELECT event_id, make_timestamp(m + k * CAST(delay * 1e6 AS BIGINT)) AS planned_at FROM m""")
def g8(t):
    r = _requests(t).withColumn("delay", F.col("delay") * 5)
    return L.schedule(r, "ts", "event_id", "delay").select("event_id", "planned_at")


@query("x20_crawl_expansion", """
WITH RECURSIVE l AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY first, dst) AS rank FROM (
  SELECT l_partkey AS src, l_suppkey * 3 AS dst, min(l_orderkey) AS first FROM lineitem GROUP BY l_partkey, l_suppkey * 3)),
o AS (SELECT src, list(dst ORDER BY rank) AS dsts FROM l WHERE rank <= 20 AND dst IN (SELECT p_partkey FROM part) GROUP BY src),
w AS (SELECT s_suppkey AS crawl_id, 1 AS k, [s_suppkey] AS queue FROM supplier WHERE s_suppkey IN (SELECT p_partkey FROM part)
 UNION ALL SELECT crawl_id, k + 1, list_concat(queue, coalesce(list_filter(dsts, lambda d: NOT list_contains(queue, d)), [])) FROM w LEFT JOIN o ON o.src = queue[k] WHERE k < 10 AND k <= len(queue)),
q AS (SELECT crawl_id, arg_max(queue, k) AS queue FROM w GROUP BY crawl_id)
SELECT crawl_id, concat('https://parts.example.com/', CAST(part AS STRING)) AS url, position FROM (SELECT crawl_id, unnest(queue) AS part, CAST(unnest(range(1, len(queue) + 1)) AS BIGINT) AS position FROM q)""")
def x20(t):
    """Parts as pages that link to other parts; one crawl per supplier."""
    name = lambda c: F.concat(F.lit("https://parts.example.com/"), c.cast("string"))
    pages = t["part"].select(name(F.col("p_partkey")).alias("url"))
    pairs = t["lineitem"].groupBy(F.col("l_partkey").alias("src"), (F.col("l_suppkey") * 3).alias("dst")).agg(F.min("l_orderkey").alias("first"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy("first", "dst"))
    table = pairs.withColumn("rank", rank).select(name(F.col("src")).alias("page_url"), name(F.col("dst")).alias("url"), "rank")
    seeds = t["supplier"].select(F.col("s_suppkey").alias("crawl_id"), name(F.col("s_suppkey")).alias("url"))
    return L.crawl_rounds(seeds, table, pages, max_pages=10)


@query("j29_crawl_settings", """
WITH s AS (SELECT c_custkey AS id, concat('https://www.', CASE c_custkey % 4 WHEN 0 THEN 'Amazon.com' WHEN 1 THEN 'linkedin.com' WHEN 2 THEN 'x.com' ELSE 'shop.org' END, '/', CAST(c_custkey AS STRING)) AS url,
 CAST(c_custkey % 9 + 1 AS INT) AS w, (c_custkey % 10 + 1) * 0.25 AS d, CAST(c_custkey % 5 AS INT) AS r, CAST(c_custkey % 5 + 1 AS INT) AS depth, CAST(5 + c_custkey % 6 AS INT) AS tmo, c_custkey % 4 AS k FROM customer)
SELECT id, CASE k WHEN 0 THEN greatest(w, 8) WHEN 2 THEN greatest(w, 10) ELSE w END AS wait_time, CASE k WHEN 0 THEN greatest(d, 2.0) WHEN 1 THEN greatest(d, 3.0) ELSE d END::DOUBLE AS delay,
 CASE k WHEN 1 THEN least(r, 2) ELSE r END AS max_retries, CAST((depth > 3)::INT + (d < 0.5 AND k = 3)::INT + (tmo < CASE k WHEN 0 THEN greatest(w, 8) WHEN 2 THEN greatest(w, 10) ELSE w END)::INT AS INT) AS errors FROM s""")
def j29(t):
    c = F.col("c_custkey")
    site = F.when(c % 4 == 0, "Amazon.com").when(c % 4 == 1, "linkedin.com").when(c % 4 == 2, "x.com").otherwise("shop.org")
    s = t["customer"].select(
        c.alias("id"), F.concat(F.lit("https://www."), site, F.lit("/"), c.cast("string")).alias("url"), (c % 9 + 1).cast("int").alias("wait_time"),
        ((c % 10 + 1) * 0.25).alias("delay"), (c % 5).cast("int").alias("max_retries"), (c % 5 + 1).cast("int").alias("max_depth"),
        (5 + c % 6).cast("int").alias("timeout"), F.lit(True).alias("follow_links"), F.lit(False).alias("use_stealth"))
    return L.crawl_settings(s).select("id", "wait_time", "delay", "max_retries", F.size("errors").alias("errors"))


@query("m5_table_function", f"WITH {PARTS} SELECT page_id, {un('href')} AS href FROM ln", ["v_pages"])
def m5(t):
    return L.page_links(X.extract_pages(t.pages().select("page_id", "raw_html"))).select("page_id", "href")



@query("m5_sql_links", f"WITH {PARTS} SELECT page_id, {un('href')} AS href FROM ln", ["v_pages"])
def m5b(t):
    """Links of extracted pages by SQL alone."""
    L.register_functions(t.spark)
    found = X.extract_pages(t.pages().select("page_id", "raw_html")).select("page_id", "anchors")
    return t.spark.sql("SELECT p.page_id, l.href FROM {found} p, LATERAL page_links(p.anchors) l", found=found)


@query("m5_sql_cells", ORACLE["x11_table_cells"])
def m5c(t):
    """Table cells of extracted pages by SQL alone."""
    L.register_functions(t.spark)
    found = X.extract_pages(cell_pages(t)).select("page_id", "tables")
    return t.spark.sql("SELECT p.page_id, c.caption, c.row, c.header, c.value FROM {found} p, LATERAL table_cells(p.tables) c", found=found)
