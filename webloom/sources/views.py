"""Input tables and the crawl-shaped views over them.

``Tables`` opens the stored Parquet tables lazily and offers the views every operator is run on:
jobs, records, performance events, job logs and pages. ``VIEW_SQL`` states the same views in SQL
for the result check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.session import spread

VIEW_DEPS: dict[str, tuple[str, ...]] = {}

VIEW_SQL: dict[str, str] = {
    "v_jobs": """
SELECT o.o_orderkey AS job_id,
  concat('https://', lower(substr(o.o_orderstatus,1,1)), CAST(o.o_custkey % 5 AS STRING), '.example.com/', CAST(o.o_orderkey AS STRING)) AS url,
  CASE WHEN o.o_orderkey % 11 = 0 THEN 'failed' WHEN o.o_orderkey % 13 = 0 THEN 'cancelled'
       WHEN o.o_orderstatus = 'F' THEN 'completed' WHEN o.o_orderstatus = 'P' THEN 'running' ELSE 'pending' END AS status,
  o.o_orderdate AS created_at, min(l.l_shipdate) AS started_at, max(l.l_shipdate) AS completed_at,
  CAST(count(l.l_linenumber) AS INT) AS total_pages,
  CAST(coalesce(sum(CASE WHEN l.l_returnflag <> 'R' THEN 1 ELSE 0 END), 0) AS INT) AS pages_completed,
  CAST(coalesce(sum(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END), 0) AS INT) AS pages_failed,
  o.o_custkey AS user_id, CAST(1 + o.o_orderkey % 10 AS INT) AS priority,
  CASE WHEN o.o_orderkey % 11 = 0 THEN concat('E', CAST(o.o_custkey % 4 AS STRING)) END AS error_message,
  CASE WHEN o.o_custkey % 3 = 0 THEN o.o_orderpriority END AS name,
  CAST(o.o_orderkey % 4 AS INT) AS retry_count
FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey
GROUP BY o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_orderdate, o.o_orderpriority""",
    "v_scraped_data": """
SELECT d.doc_id AS data_id, 1 + d.doc_id % 100 AS job_id,
  concat('https://', d.source, '.example.com/', d.lang, '/', CAST(d.doc_id AS STRING)) AS url,
  CASE d.doc_id % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'text' ELSE 'html' END AS content_type,
  split_part(d.text, '.', 1) AS title, d.text AS text,
  CAST(d.doc_id * 37 % 101 AS DOUBLE) / 100 AS confidence_score,
  (l.doc_id IS NOT NULL) AS ai_processed,
  CAST(CASE WHEN l.quality = 1 THEN 0.9 WHEN l.quality = 0 THEN 0.2 ELSE 0.5 END AS DOUBLE) AS data_quality_score,
  e.ts AS extracted_at, CAST(length(d.text) AS BIGINT) AS content_length,
  CASE WHEN d.doc_id % 7 = 0 THEN 'missing_title' END AS err_a,
  CASE WHEN coalesce(l.toxic, 0) = 1 THEN 'toxic_text' END AS err_b
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN events e ON e.event_id = d.doc_id""",
    "v_perf": """
SELECT event_id AS metric_id, concat('op_', CAST(user_id % 5 AS STRING)) AS operation_name, value AS duration_ms,
  (event_type <> 'error') AS success,
  CASE WHEN event_type = 'error' THEN concat('E', CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 4 AS STRING)) END AS error_type,
  user_id AS client_id, ts AS recorded_at FROM events""",
    "v_job_logs": """
SELECT conv_id * 1000 + turn AS log_id, 1 + conv_id % 100 AS job_id,
  CASE role WHEN 'user' THEN 'INFO' WHEN 'assistant' THEN 'WARNING' ELSE 'ERROR' END AS level, text AS message FROM conversations""",
    "v_pages": """
SELECT page_id, url, html AS raw_html, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages""",
    "v_contacts": """
SELECT c_custkey AS data_id,
  CASE c_custkey % 4 WHEN 0 THEN concat(' ', replace(c_name, '#', '.'), '@Mail.Example.COM ') WHEN 1 THEN concat(c_name, '@x.org') WHEN 2 THEN c_mktsegment ELSE '' END AS email,
  CASE c_custkey % 5 WHEN 0 THEN concat('+1 (555) ', CAST(c_custkey AS STRING), '-', CAST(c_custkey % 100 AS STRING)) WHEN 1 THEN concat('0', CAST(c_custkey * 7919 AS STRING), '-77') WHEN 2 THEN 'n/a' WHEN 3 THEN CAST(c_custkey AS STRING) END AS phone,
  CASE c_custkey % 4 WHEN 0 THEN concat('//shop', CAST(c_custkey AS STRING), '.example.com/x#top') WHEN 1 THEN concat('shop', CAST(c_custkey AS STRING), '.example.com') WHEN 2 THEN concat(' https://u:p@s', CAST(c_custkey AS STRING), '.example.com:8080/a?b=1 ') ELSE 'nodots' END AS url,
  CASE c_custkey % 4 WHEN 0 THEN concat('USD ', CAST(c_acctbal AS STRING)) WHEN 1 THEN concat('1,', CAST(100 + c_custkey % 900 AS STRING), '.5 EUR') WHEN 2 THEN 'free' ELSE ',' END AS price,
  concat('  ', c_mktsegment, '   ', chr(10), c_name, ' ', CAST(c_nationkey AS STRING), ' ') AS text
FROM customer""",
    "v_alerts": """
SELECT event_id AS alert_id, CASE WHEN value > 40 THEN 'critical' WHEN value > 10 THEN 'high' ELSE 'low' END AS severity,
  CASE WHEN event_id % 3 = 0 THEN 'resolved' WHEN event_id % 3 = 1 THEN 'acknowledged' ELSE 'active' END AS status,
  value AS actual_value, ts AS triggered_at,
  CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 DAY END AS resolved_at
FROM events WHERE event_type = 'error'""",
}


class Tables:
    """Lazy access to one folder of tables and to the views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def texts(self) -> DataFrame:
        """Documents for text work, on all cores even where the file has few row groups."""
        return spread(self["documents"])

    def jobs(self) -> DataFrame:
        # Line items are summed per order first: the join then moves one row per order, and the
        # partitioning of the sum is the one the join needs.
        returned = F.col("l_returnflag") == "R"
        pages = self["lineitem"].groupBy("l_orderkey").agg(
            F.min("l_shipdate").alias("started_at"),
            F.max("l_shipdate").alias("completed_at"),
            F.count("l_linenumber").alias("total_pages"),
            F.count_if(~returned).alias("pages_completed"),
            F.count_if(returned).alias("pages_failed"),
        )
        key, cust = F.col("o_orderkey"), F.col("o_custkey")
        status = (
            F.when(key % 11 == 0, "failed")
            .when(key % 13 == 0, "cancelled")
            .when(F.col("o_orderstatus") == "F", "completed")
            .when(F.col("o_orderstatus") == "P", "running")
            .otherwise("pending")
        )

        def pages_or_zero(name: str) -> Column:
            return F.coalesce(F.col(name), F.lit(0)).cast("int").alias(name)

        return (
            self["orders"]
            .join(pages, F.col("o_orderkey") == F.col("l_orderkey"), "left")
            .select(
                key.alias("job_id"),
                F.concat(
                    F.lit("https://"), F.lower(F.substring("o_orderstatus", 1, 1)), (cust % 5).cast("string"),
                    F.lit(".example.com/"), key.cast("string"),
                ).alias("url"),
                status.alias("status"),
                F.col("o_orderdate").alias("created_at"),
                "started_at",
                "completed_at",
                pages_or_zero("total_pages"),
                pages_or_zero("pages_completed"),
                pages_or_zero("pages_failed"),
                cust.alias("user_id"),
                (1 + key % 10).cast("int").alias("priority"),
                F.when(key % 11 == 0, F.concat(F.lit("E"), (cust % 4).cast("string"))).alias("error_message"),
                F.when(cust % 3 == 0, F.col("o_orderpriority")).alias("name"),
                (key % 4).cast("int").alias("retry_count"),
            )
        )

    def records(self) -> DataFrame:
        docs, labels, events = self["documents"], self["labels"], self["events"]
        labels = labels.select(F.col("doc_id").alias("l_doc"), "quality", "toxic")
        times = events.select(F.col("event_id").alias("e_id"), F.col("ts").alias("extracted_at"))
        doc = F.col("doc_id")
        return (
            docs.join(labels, doc == F.col("l_doc"), "left")
            .join(times, doc == F.col("e_id"), "left")
            .select(
                doc.alias("data_id"),
                (1 + doc % 100).alias("job_id"),
                F.concat(
                    F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.col("lang"), F.lit("/"),
                    doc.cast("string"),
                ).alias("url"),
                F.when(doc % 5 == 0, "json").when(doc % 5 == 1, "text").otherwise("html").alias("content_type"),
                F.split_part("text", F.lit("."), F.lit(1)).alias("title"),
                "text",
                ((doc * 37 % 101).cast("double") / 100).alias("confidence_score"),
                F.col("l_doc").isNotNull().alias("ai_processed"),
                F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.2).otherwise(0.5)
                .alias("data_quality_score"),
                "extracted_at",
                F.length("text").cast("long").alias("content_length"),
                F.when(doc % 7 == 0, "missing_title").alias("err_a"),
                F.when(F.coalesce(F.col("toxic"), F.lit(0)) == 1, "toxic_text").alias("err_b"),
            )
        )

    def records_with_errors(self) -> DataFrame:
        errors = F.array_compact(F.array("err_a", "err_b"))
        return self.records().withColumn("validation_errors", errors).drop("err_a", "err_b")

    def perf(self) -> DataFrame:
        failed = F.col("event_type") == "error"
        code = F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 4
        return self["events"].select(
            F.col("event_id").alias("metric_id"),
            F.concat(F.lit("op_"), (F.col("user_id") % 5).cast("string")).alias("operation_name"),
            F.col("value").alias("duration_ms"),
            (~failed).alias("success"),
            F.when(failed, F.concat(F.lit("E"), code.cast("string"))).alias("error_type"),
            F.col("user_id").alias("client_id"),
            F.col("ts").alias("recorded_at"),
        )

    def job_logs(self) -> DataFrame:
        role = F.col("role")
        return self["conversations"].select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("log_id"),
            (1 + F.col("conv_id") % 100).alias("job_id"),
            F.when(role == "user", "INFO").when(role == "assistant", "WARNING").otherwise("ERROR").alias("level"),
            F.col("text").alias("message"),
        )

    def pages(self) -> DataFrame:
        return self["pages"].select(
            "page_id", "url", F.col("html").alias("raw_html"),
            F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"),
        )

    def contacts(self) -> DataFrame:
        key = F.col("c_custkey")
        num = key.cast("string")

        def cat(*parts: object) -> Column:
            return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

        return self["customer"].select(
            key.alias("data_id"),
            F.when(key % 4 == 0, cat(" ", F.replace("c_name", F.lit("#"), F.lit(".")), "@Mail.Example.COM "))
            .when(key % 4 == 1, cat(F.col("c_name"), "@x.org")).when(key % 4 == 2, F.col("c_mktsegment"))
            .otherwise("").alias("email"),
            F.when(key % 5 == 0, cat("+1 (555) ", num, "-", (key % 100).cast("string")))
            .when(key % 5 == 1, cat("0", (key * 7919).cast("string"), "-77"))
            .when(key % 5 == 2, "n/a").when(key % 5 == 3, num).alias("phone"),
            F.when(key % 4 == 0, cat("//shop", num, ".example.com/x#top"))
            .when(key % 4 == 1, cat("shop", num, ".example.com"))
            .when(key % 4 == 2, cat(" https://u:p@s", num, ".example.com:8080/a?b=1 ")).otherwise("nodots").alias("url"),
            F.when(key % 4 == 0, cat("USD ", F.col("c_acctbal").cast("string")))
            .when(key % 4 == 1, cat("1,", (100 + key % 900).cast("string"), ".5 EUR"))
            .when(key % 4 == 2, "free").otherwise(",").alias("price"),
            cat("  ", F.col("c_mktsegment"), "   \n", F.col("c_name"), " ", F.col("c_nationkey").cast("string"), " ").alias("text"),
        )

    def alerts(self) -> DataFrame:
        value, third = F.col("value"), F.col("event_id") % 3
        return self["events"].where("event_type = 'error'").select(
            F.col("event_id").alias("alert_id"),
            F.when(value > 40, "critical").when(value > 10, "high").otherwise("low").alias("severity"),
            F.when(third == 0, "resolved").when(third == 1, "acknowledged").otherwise("active").alias("status"),
            value.alias("actual_value"),
            F.col("ts").alias("triggered_at"),
            F.when(third == 0, F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("resolved_at"),
        )
