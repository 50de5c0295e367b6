"""Crawl planning over stored pages: frontier, robots rules, politeness, expansion."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from webloom.functions.common import any_of, micros
from webloom.functions.urls import host, path
from webloom.operators.ordered import lagged, spaced
from webloom.operators.pages import EXTRACT
from webloom.session import shared_folder, written

# What marks the links of further pages and of articles.
PAGING = ("page", "p=", "offset")
ARTICLES = ("/article/", "/post/", "/blog/", "/news/", "/product/")
PER_PAGE = 20

RULE = "user_agent string, line_no int, allow boolean, path string, crawl_delay double, requests int, seconds int"


def frontier(links: DataFrame, per_page: int = PER_PAGE) -> DataFrame:
    """Links worth following per page: paging links before article links, same host, once each, at most 20."""
    # the two kinds are told by the link as written or by the element around it
    paging = F.coalesce("pager", F.lit(False)) | any_of(F.col("url").contains(p) for p in PAGING)
    article = F.coalesce("article", F.lit(False)) | any_of(F.col("url").contains(p) for p in ARTICLES)
    kept = links.where((paging | article) & ~F.col("is_external") & (F.col("url") != F.col("page_url")))
    once = kept.groupBy("page_id", "page_url", "url").agg(F.min(F.struct((~paging).alias("later"), "pos")).alias("place"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("place", "url"))
    return once.withColumn("rank", rank).where(F.col("rank") <= per_page).drop("place")


def unseen(candidates: DataFrame, seen: DataFrame, url: str = "url") -> DataFrame:
    """Candidates that were neither read nor queued before."""
    return candidates.join(seen.select(F.col(url)).distinct(), url, "left_anti")


class SeenTable:
    """Rows that were read or queued, stored by the hash of their keys.

    The table is bucketed by ``keys``: looking candidates up sends only the candidates through a shuffle, the stored
    side is read bucket by bucket. ``add`` appends the new rows and touches no old file. The table lies in the shared
    folder; ``drop`` takes it out of the catalogue.
    """

    def __init__(self, spark: SparkSession, keys: Sequence[str] = ("url",), buckets: int | None = None, name: str | None = None):
        self.spark, self.keys = spark, list(keys)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = name or f"seen_{uuid.uuid4().hex}"

    def add(self, rows: DataFrame) -> DataFrame:
        """Appends ``rows``, which hold the keys and any other columns, the same each time."""
        writer = rows.repartition(self.buckets, *self.keys).write.bucketBy(self.buckets, *self.keys).mode("append").format("parquet")
        if not self.spark.catalog.tableExists(self.name):
            writer = writer.option("path", f"{shared_folder(self.spark)}/{self.name}")
        writer.saveAsTable(self.name)
        return self.rows()

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, candidates: DataFrame) -> DataFrame:
        """Candidates whose keys are not stored."""
        # a hint, no order to collect: a broadcast of the stored side would grow with it
        return candidates.join(self.rows().select(*self.keys).hint("shuffle_hash"), self.keys, "left_anti")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def pagination_union(first: Column, second: Column) -> Column:
    return F.array_union(first, second)


# --- robots --------------------------------------------------------------------------------

class RobotsRules:
    """Rows of a robots.txt text, one per rule line, for use in SQL: ``robots_rules(text)``."""

    def eval(self, text: str):
        agents, open_group = [], False
        for number, line in enumerate((text or "").splitlines()):
            name, found, value = line.split("#", 1)[0].partition(":")
            name, value = name.strip().lower(), value.strip()
            if not found:
                continue
            if name == "user-agent":
                agents = [*agents, value.lower()] if open_group else [value.lower()]
                open_group = True
                continue
            open_group = False
            row = {"allow": None, "path": None, "delay": None, "requests": None, "seconds": None}
            if name in ("allow", "disallow"):
                row["allow"], row["path"] = name == "allow" or value == "", value or "/"
            elif name == "crawl-delay" and value.replace(".", "", 1).isdigit():
                row["delay"] = float(value)
            elif name == "request-rate" and all(part.strip().isdigit() for part in value.split("/")) and value.count("/") == 1:
                row["requests"], row["seconds"] = (int(part) for part in value.split("/"))
            else:
                continue
            for agent in agents:
                yield (agent, number, row["allow"], row["path"], row["delay"], row["requests"], row["seconds"])


def page_links(extracts: DataFrame) -> DataFrame:
    """(page_id, pos, href, text) of every link of extracted pages: the pages are read once, whatever is expanded."""
    return extracts.select("page_id", F.posexplode("anchors").alias("pos", "a")).select("page_id", "pos", "a.href", "a.text")


def register_functions(spark: SparkSession) -> None:
    """Table functions for SQL users: robots_rules(text), page_links(anchors), table_cells(tables).

    The last two expand columns of extracted pages. They are SQL functions, which Catalyst puts in place: no Python runs.
    Each has one generator only; with lateral ones inside, pages would be read a second time and joined by their tables.
    """
    spark.udtf.register("robots_rules", udtf(RobotsRules, returnType=RULE))
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION page_links(anchors {EXTRACT["anchors"].dataType.simpleString()})
        RETURNS TABLE (pos INT, href STRING, text STRING) RETURN SELECT pos, a.href, a.text FROM posexplode(anchors) AS x(pos, a)""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION table_cells(tables {EXTRACT["tables"].dataType.simpleString()})
        RETURNS TABLE (`table` INT, caption STRING, `row` INT, col INT, header STRING, value STRING)
        RETURN SELECT n, caption, r, c, header, value
        FROM inline(flatten(transform(tables, (t, n) -> flatten(transform(coalesce(t.rows, array()), (cells, r) -> transform(coalesce(cells, array()), (value, c) ->
            named_struct('n', n, 'caption', t.caption, 'r', r, 'c', c, 'header', get(t.headers, c), 'value', value))))))) AS x(n, caption, r, c, header, value)""")


def robots_rules(spark: SparkSession, robots: DataFrame) -> DataFrame:
    """(host, rule columns) of a table (host, text)."""
    register_functions(spark)
    return spark.sql("SELECT r.host, x.* FROM {robots} r, LATERAL robots_rules(r.text) x", robots=robots)


def robots_permission(urls: DataFrame, rules: DataFrame, user_agent: str = "*") -> DataFrame:
    """Adds allowed, crawl_delay, request_rate and recommended_delay per URL.

    The rules of a host become one row (the text of one robots.txt), so a host with very many URLs
    joins against a single row. The group of the agent itself goes before the general one, and in a
    group the first rule whose path begins the URL's path decides. No rules, no limits.
    """
    agent = user_agent.lower()
    mine = F.lit(agent).contains(F.col("user_agent")) & (F.col("user_agent") != "*")
    grouped = rules.where(mine | (F.col("user_agent") == "*")).groupBy("host").agg(
        F.array_sort(F.collect_list(F.struct((~mine).alias("general"), "line_no", "allow", "path", "crawl_delay", "requests", "seconds"))).alias("__r"))
    own = F.filter("__r", lambda r: ~r["general"])
    chosen = grouped.select("host", F.when(F.size(own) > 0, own).otherwise(F.col("__r")).alias("__rules"))
    here = F.when(F.col("__path") == "", "/").otherwise(F.col("__path"))
    hit = F.try_element_at(F.filter("__rules", lambda r: r["path"].isNotNull() & F.startswith(here, r["path"])), F.lit(1))
    delay = F.try_element_at(F.filter("__rules", lambda r: r["crawl_delay"].isNotNull()), F.lit(1))["crawl_delay"]
    rate = F.try_element_at(F.filter("__rules", lambda r: r["requests"].isNotNull()), F.lit(1))
    pace = F.when(rate["requests"] > 0, rate["seconds"] / F.nullif(rate["requests"], F.lit(0))).otherwise(1.0)
    rest = F.regexp_extract("url", r"^[^:]+://[^/?#]*[^?#]*(\?[^#]*)?", 1)
    out = urls.withColumns({"host": host("url"), "__path": F.concat(path("url"), rest)}).join(chosen, "host", "left")
    allowed = F.coalesce(hit["allow"], F.lit(True))
    return out.select(
        *urls.columns, *(["host"] if "host" not in urls.columns else []), allowed.alias("allowed"),
        F.when(allowed, delay).alias("crawl_delay"),
        F.when(allowed & rate.isNotNull(), F.concat_ws("/", rate["requests"].cast("string"), rate["seconds"].cast("string"))).alias("request_rate"),
        F.when(allowed, F.greatest(F.lit(1.0), F.coalesce(delay, F.lit(1.0)), F.when(rate.isNotNull(), pace).otherwise(1.0)))
        .otherwise(1.0).alias("recommended_delay"),
    )


# --- politeness ----------------------------------------------------------------------------

def request_gaps(requests: DataFrame, ts: str, tie: str, seconds: int = 86400) -> DataFrame:
    """Seconds since the request before on the same host; null for the first."""
    out = lagged(requests, ["host"], [ts, tie], {"__before": ts}, seconds)
    return out.withColumn("gap_seconds", (micros(ts) - micros("__before")) / 1e6).drop("__before")


def schedule(requests: DataFrame, ts: str, tie: str, delay: str, seconds: int = 86400) -> DataFrame:
    """Planned time of each request: not before it is due, nor before the one ahead plus the host's delay.

    The delay is constant per host.
    """
    planned = spaced(requests, ["host"], [ts, tie], F.round(F.col(delay) * 1e6).cast("long"), "__planned", seconds)
    return planned.withColumn("planned_at", F.timestamp_micros("__planned").cast(requests.schema[ts].dataType)).drop("__planned")


# --- expansion -----------------------------------------------------------------------------

def crawl_rounds(seeds: DataFrame, links: DataFrame, pages: DataFrame, max_pages: int = 10, per_page: int = PER_PAGE) -> DataFrame:
    """Breadth-first expansion of each crawl (crawl_id, url) over stored pages.

    Pages are taken first in, first out; a page passes on its first ``per_page`` links (page_url, url, rank) while
    fewer than ``max_pages`` pages of its crawl were read. Seeds stand in the order of their column ``rank``, where
    they have one, else of url. Result: (crawl_id, url, position). The links between stored pages are found and stored
    once, by the page they are on. Each round joins the new pages of all crawls with
    them, looks up what it finds in the stored set of pages read, and appends what is new to it: a round
    writes its new rows only. At most ``max_pages`` rounds can find anything; a crawl has at most its seeds and
    ``max_pages * per_page`` pages.
    """
    known = pages.select(F.col("url").alias("known_url")).distinct()
    outgoing = links.where(F.col("rank") <= per_page).select(F.col("page_url").alias("from_url"), F.col("url").alias("to_url"), "rank")
    stored = SeenTable(seeds.sparkSession, ["from_url"])
    outgoing = stored.add(outgoing.join(known, F.col("to_url") == F.col("known_url"), "left_semi"))
    given = F.min("rank") if "rank" in seeds.columns else F.lit(0)
    start = seeds.groupBy("crawl_id", "url").agg(given.alias("rank")).join(known, F.col("url") == F.col("known_url"), "left_semi")
    place = Window.partitionBy("crawl_id").orderBy(F.asc_nulls_last("rank"), "url")
    fresh = written(start.select("crawl_id", "url", F.row_number().over(place).cast("long").alias("position")))
    seen = SeenTable(seeds.sparkSession, ["crawl_id", "url"])
    read = seen.add(fresh)
    for _ in range(max_pages):
        open_ = fresh.where(F.col("position") < max_pages)
        if open_.isEmpty():
            break
        found = (
            open_.join(outgoing, F.col("url") == F.col("from_url"))
            .groupBy("crawl_id", F.col("to_url").alias("url")).agg(F.min(F.struct("position", "rank")).alias("place")))
        # a crawl that found nothing in the last round has no new pages now
        ends = fresh.groupBy("crawl_id").agg(F.max("position").alias("so_far"))
        order = Window.partitionBy("crawl_id").orderBy("place")
        fresh = written(
            seen.unseen(found).withColumn("n", F.row_number().over(order)).join(ends, "crawl_id")
            .select("crawl_id", "url", (F.col("so_far") + F.col("n")).alias("position")))
        if fresh.isEmpty():
            break
        read = seen.add(fresh)
    stored.drop()
    return read


# Settings that some hosts need, and the limits a configuration must keep.
HOST_SETTINGS: Mapping[str, Mapping[str, float]] = {
    "amazon.com": {"wait_time": 8, "delay": 2.0},
    "linkedin.com": {"delay": 3.0, "max_retries": 2},
    "twitter.com": {"wait_time": 10},
    "x.com": {"wait_time": 10},
}


def crawl_settings(urls: DataFrame) -> DataFrame:
    """Columns wait_time, delay and max_retries raised (retries lowered) for hosts with special needs."""
    lowered = F.lower("url")
    kinds = [("amazon.com", lowered.contains("amazon.com")), ("linkedin.com", lowered.contains("linkedin.com")),
             ("twitter.com", lowered.contains("twitter.com") | lowered.contains("x.com"))]

    def pick(setting: str) -> Column:
        out = F.lit(None).cast("double")
        for name, test in reversed(kinds):
            value = HOST_SETTINGS[name].get(setting)
            out = F.when(test, F.lit(None if value is None else float(value)).cast("double")).otherwise(out)
        return out

    stealth = F.coalesce(F.col("use_stealth"), F.lit(False)) | any_of(test for _, test in kinds)
    changed = urls.withColumns({
        "wait_time": F.greatest("wait_time", pick("wait_time").cast("int")),
        "delay": F.greatest("delay", pick("delay")),
        "max_retries": F.least("max_retries", pick("max_retries").cast("int")),
        "use_stealth": stealth,
    })
    errors = F.array_compact(F.array(
        F.when((F.col("max_depth") > 3) & F.col("follow_links"), F.lit("max_depth should not exceed 3 when follow_links is enabled")),
        F.when((F.col("delay") < 0.5) & ~F.col("use_stealth"), F.lit("delay_between_requests should be at least 0.5 seconds without stealth mode")),
        F.when(F.col("timeout") < F.col("wait_time"), F.lit("timeout should be greater than wait_time")),
    ))
    return changed.withColumn("errors", errors)


