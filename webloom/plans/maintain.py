"""Maintenance queries, and exports read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from webloom.functions.urls import is_job_url
from webloom.operators import cleaning as O
from webloom.operators import maintain as M
from webloom.plans.records import JOBS_NOW, NOW
from webloom.plans.registry import query
from webloom.session import shared_folder, written
from webloom.sources import sinks as W
from webloom.sources.days import DayTable

CHANGES = """
c AS (SELECT l_orderkey AS job_id, l_shipdate AS changed_at, l_linenumber * 1000000 + l_partkey AS seq, CASE WHEN l_returnflag = 'A' THEN 'running' WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linestatus = 'O' THEN 'retry' ELSE 'completed' END AS status,
 CASE WHEN l_returnflag = 'R' THEN l_linestatus END AS error_message, CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS INT) END AS pages_completed FROM lineitem)
"""


def changes(t):
    flag = F.col("l_returnflag")
    return t["lineitem"].select(
        F.col("l_orderkey").alias("job_id"), F.col("l_shipdate").alias("changed_at"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("seq"),
        F.when(flag == "A", "running").when(flag == "R", "failed").when(F.col("l_linestatus") == "O", "retry").otherwise("completed").alias("status"),
        F.when(flag == "R", F.col("l_linestatus")).alias("error_message"),
        F.when(flag != "R", F.col("l_quantity").cast("int")).alias("pages_completed"), F.lit(None).cast("int").alias("pages_failed"))


@query("n1_status_upsert", f"""
WITH {CHANGES}, g AS (SELECT job_id, arg_max(status, (changed_at, seq)) AS s, max(changed_at) FILTER (WHERE status = 'running') AS st, max(changed_at) FILTER (WHERE status IN ('completed', 'failed', 'cancelled')) AS en,
 arg_max(error_message, (changed_at, seq)) FILTER (WHERE error_message IS NOT NULL) AS e, arg_max(pages_completed, (changed_at, seq)) FILTER (WHERE pages_completed IS NOT NULL) AS p, count(*) FILTER (WHERE status = 'retry') AS r FROM c GROUP BY job_id)
SELECT j.job_id, coalesce(CASE WHEN s = 'retry' THEN 'pending' ELSE s END, j.status) AS status, coalesce(st, j.started_at) AS started_at, coalesce(en, j.completed_at) AS completed_at, coalesce(e, j.error_message) AS error_message,
 coalesce(p, j.pages_completed) AS pages_completed, CAST(j.retry_count + coalesce(r, 0) AS INT) AS retry_count FROM v_jobs j LEFT JOIN g ON g.job_id = j.job_id""", ["v_jobs"])
def n1(t):
    return M.apply_status(t.jobs(), changes(t)).select("job_id", "status", "started_at", "completed_at", "error_message", "pages_completed", "retry_count")


@query("n1_matched_changes", f"""
WITH {CHANGES} SELECT DISTINCT c.job_id, o.o_orderkey IS NOT NULL AS matched FROM (SELECT job_id FROM c UNION SELECT c_custkey * 1000003 FROM customer) c LEFT JOIN orders o ON o.o_orderkey = c.job_id""")
def n1b(t):
    asked = changes(t).select("job_id").union(t["customer"].select(F.col("c_custkey") * 1000003))
    return M.matched_changes(t.jobs(), asked)


@query("n2_analysis_update", """
SELECT r.data_id, coalesce(l.quality / 2.0::DOUBLE, r.confidence_score) AS confidence_score, CASE WHEN l.doc_id IS NOT NULL THEN l.toxic::DOUBLE ELSE r.data_quality_score END AS data_quality_score FROM v_scraped_data r LEFT JOIN labels l ON l.doc_id = r.data_id""", ["v_scraped_data"])
def n2(t):
    new = t["labels"].select(F.col("doc_id").alias("data_id"), (F.col("quality") / 2.0).alias("confidence_score"), F.col("toxic").cast("double").alias("data_quality_score"))
    out = M.apply_updates(t.records(), new, "data_id", ["confidence_score", "data_quality_score"])
    return out.select("data_id", "confidence_score", "data_quality_score")


@query("e10_reprocess", """
SELECT data_id, CASE WHEN data_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN CAST(length(text) AS DOUBLE) ELSE data_quality_score END AS data_quality_score FROM v_scraped_data""", ["v_scraped_data"])
def e10(t):
    ids = t["labels"].where("toxic = 1").select(F.col("doc_id").alias("data_id"))
    out = M.reprocess(t.records(), ids, lambda df: df.withColumn("data_quality_score", F.length("text").cast("double")), "data_id", ["data_quality_score"])
    return out.select("data_id", "data_quality_score")


@query("n4_alert_changes", """
WITH q AS (SELECT event_id AS alert_id, CASE WHEN event_id % 2 = 0 THEN 'acknowledge' ELSE 'resolve' END AS action, ts + INTERVAL 2 HOUR AS requested_at FROM events WHERE event_type = 'error' AND user_id < 75
 UNION ALL SELECT event_id, 'resolve', ts + INTERVAL 3 HOUR FROM events WHERE event_type = 'error' AND user_id < 20),
l AS (SELECT alert_id, arg_max(action, requested_at) AS action, max(requested_at) FILTER (WHERE action = 'acknowledge') AS ack, max(requested_at) FILTER (WHERE action = 'resolve') AS res FROM q GROUP BY alert_id)
SELECT a.alert_id, CASE action WHEN 'acknowledge' THEN 'acknowledged' WHEN 'resolve' THEN 'resolved' ELSE status END AS status, ack AS acknowledged_at, coalesce(res, resolved_at) AS resolved_at FROM v_alerts a LEFT JOIN l ON l.alert_id = a.alert_id""", ["v_alerts"])
def n4(t):
    e = t["events"].where("event_type = 'error'")
    first = e.where("user_id < 75").select(
        F.col("event_id").alias("alert_id"), F.when(F.col("event_id") % 2 == 0, "acknowledge").otherwise("resolve").alias("action"),
        (F.col("ts") + F.expr("INTERVAL 2 HOUR")).alias("requested_at"))
    second = e.where("user_id < 20").select("event_id", F.lit("resolve"), F.col("ts") + F.expr("INTERVAL 3 HOUR"))
    return M.change_alerts(t.alerts(), first.union(second)).select("alert_id", "status", "acknowledged_at", "resolved_at")


POLICY = {"scraped_data": 20, "alerts": 10, "performance_metrics": 14}


@query("n5_retention_cleanup", f"SELECT metric_id, recorded_at FROM v_perf WHERE recorded_at >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY", ["v_perf"])
def n5(t):
    return M.retain(t.perf(), "recorded_at", "performance_metrics", NOW, POLICY).select("metric_id", "recorded_at")


CUT = "TIMESTAMP_NTZ '2024-01-17 06:00:00'"


@query("n5_rewritten_days", """
SELECT day, count(*) AS rows, CASE WHEN day = DATE '2024-01-17' THEN 'rewritten' ELSE 'same files' END AS state
FROM (SELECT CAST(recorded_at AS DATE) AS day FROM v_perf WHERE recorded_at >= TIMESTAMP '2024-01-17 06:00:00') GROUP BY day""", ["v_perf"])
def n5c(t):
    """Days of a stored table after its clean-up, and whether their files are those of before."""
    table = DayTable(t.spark, "recorded_at")
    table.append(t.perf())
    day, path = F.to_date("recorded_at").alias("day"), F.col("_metadata.file_path").alias("file")
    earlier = written(t.spark.table(table.name).select(day, path).distinct())
    table.retain(F.expr(CUT))
    now = t.spark.table(table.name).select(day, path)
    known = earlier.select("file", F.lit(True).alias("known"))
    state = F.when(F.bool_and(F.coalesce("known", F.lit(False))), "same files").otherwise("rewritten")
    return now.groupBy("day", "file").agg(F.count(F.lit(1)).alias("rows")).join(known, "file", "left") \
        .groupBy("day").agg(F.sum("rows").alias("rows"), state.alias("state"))


@query("n5_expiring_days", """
SELECT CAST(recorded_at AS DATE) AS day, count(*) AS rows, count(*) FILTER (WHERE recorded_at < TIMESTAMP '2024-01-17 06:00:00') AS expired
FROM v_perf GROUP BY 1 HAVING count(*) FILTER (WHERE recorded_at < TIMESTAMP '2024-01-17 06:00:00') > 0""", ["v_perf"])
def n5d(t):
    table = DayTable(t.spark, "recorded_at")
    table.append(t.perf())
    return table.expiring(F.expr(CUT))


@query("n5_retention_dry_run", f"""
SELECT 'performance_metrics' AS data_type, count(*) FILTER (WHERE recorded_at < TIMESTAMP '{NOW}' - INTERVAL 14 DAY) AS expired FROM v_perf
UNION ALL SELECT 'alerts', count(*) FILTER (WHERE triggered_at < TIMESTAMP '{NOW}' - INTERVAL 10 DAY) FROM v_alerts""", ["v_perf", "v_alerts"])
def n5b(t):
    return M.expired_counts({"performance_metrics": (t.perf(), "recorded_at"), "alerts": (t.alerts(), "triggered_at")}, NOW, POLICY)


@query("d10_retention_predicate", f"""
SELECT event_id, ts > TIMESTAMP '{NOW}' - to_days(CASE event_type WHEN 'view' THEN 7 WHEN 'click' THEN 30 WHEN 'error' THEN 10 ELSE 365 END) AS keep FROM events""")
def d10(t):
    kind = F.when(F.col("event_type") == "view", "health_checks").when(F.col("event_type") == "click", "system_metrics").when(F.col("event_type") == "error", "alerts").otherwise("unknown")
    e = t["events"].select("event_id", "ts", kind.alias("kind"))
    return e.select("event_id", M.should_retain(e, "kind", "ts", NOW, POLICY).alias("keep"))


@query("n6_old_job_cleanup", f"""
WITH g AS (SELECT job_id FROM v_jobs WHERE created_at < TIMESTAMP '{JOBS_NOW}' - INTERVAL 400 DAY AND status IN ('completed', 'failed', 'cancelled'))
SELECT 'jobs' AS "table", count(*) AS rows FROM g UNION ALL SELECT 'records', count(*) FROM v_scraped_data WHERE job_id IN (SELECT job_id FROM g) UNION ALL SELECT 'logs', count(*) FROM v_job_logs WHERE job_id IN (SELECT job_id FROM g)""", ["v_jobs", "v_scraped_data", "v_job_logs"])
def n6(t):
    return M.cleanup_counts(t.jobs(), t.records(), t.job_logs(), JOBS_NOW, 400)


@query("n7_old_metrics", f"""
SELECT 'performance_metrics' AS data_type, count(*) FILTER (WHERE recorded_at < TIMESTAMP '{NOW}' - INTERVAL 12 DAY) AS expired FROM v_perf
UNION ALL SELECT 'alerts', count(*) FILTER (WHERE status = 'resolved' AND resolved_at < TIMESTAMP '{NOW}' - INTERVAL 12 DAY) FROM v_alerts""", ["v_perf", "v_alerts"])
def n7(t):
    return M.old_metrics({"performance_metrics": (t.perf(), "recorded_at")}, t.alerts(), NOW, 12)


@query("n8_expired_sessions", "SELECT event_id, ts + INTERVAL 1 DAY AS expires_at FROM events WHERE ts + INTERVAL 1 DAY >= TIMESTAMP '2024-01-20'")
def n8(t):
    s = t["events"].select("event_id", (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("expires_at"))
    return M.live_sessions(s, "2024-01-20")


@query("n9_orphan_files", """
SELECT DISTINCT path FROM (SELECT concat('/f/', CAST(doc_id % 300 AS STRING)) AS path FROM documents WHERE lang = 'en' UNION ALL SELECT concat('/c/', source) FROM documents UNION ALL SELECT concat('/x/', CAST(o_custkey AS STRING)) FROM orders WHERE o_orderstatus = 'F')""")
def n9(t):
    en = F.col("lang") == "en"
    r = t["documents"].select(
        F.when(en, F.array(F.concat(F.lit("/f/"), (F.col("doc_id") % 300).cast("string")))).alias("file_paths"), F.concat(F.lit("/c/"), "source").alias("cache_file"))
    x = t["orders"].select(F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("/x/"), F.col("o_custkey").cast("string"))).alias("file_path"))
    return M.orphan_files(r, x)


@query("a13_export_cleanup", """
SELECT o_orderkey AS export_id FROM orders WHERE o_orderdate >= TIMESTAMP '1998-12-31' - INTERVAL 700 DAY AND NOT (o_orderkey = 11 AND o_custkey = 5)""")
def a13(t):
    ledger = t["orders"].select(F.col("o_orderkey").alias("export_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("requested_at"))
    return M.drop_export(M.retain(ledger, "requested_at", "data_exports", JOBS_NOW, {"data_exports": 700}), 11, 5).select("export_id")


# --- sources and sinks -----------------------------------------------------------------------

def folder(t, name):
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("a4_seed_jobs", """
SELECT url, 'pending' AS status, 3 AS priority, 'shop' AS config_name FROM v_contacts WHERE url LIKE 'https://%' AND url NOT LIKE '%@%'
UNION ALL SELECT concat('https://s', CAST(data_id AS STRING), '.example.com/start'), 'pending', 3, 'shop' FROM v_contacts""", ["v_contacts"])
def a4(t):
    urls = t.contacts().select("url").union(t.contacts().select(F.concat(F.lit("https://s"), F.col("data_id").cast("string"), F.lit(".example.com/start"))))
    jobs, _ = W.seed_jobs(urls, is_job_url("url"), {"name": "shop"}, priority=3)
    return jobs.select("url", "status", "priority", F.col("config")["name"].alias("config_name"))


@query("a6_appended_rows", "SELECT log_id, upper(level) AS level, 0 AS context_size, DATE '2024-01-31' AS day FROM v_job_logs", ["v_job_logs"])
def a6(t):
    root = folder(t, "rows")
    W.append_rows(t.job_logs().withColumns({"level": F.lower("level"), "created_at": F.lit(NOW).cast("timestamp")}), root, "job_logs")
    stored = t.spark.read.parquet(f"{root}/job_logs")
    return stored.select("log_id", "level", F.size("context").alias("context_size"), F.to_date("day").alias("day"))


@query("a6_metric_rows", """SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'system_snapshot' END AS metric_name,
 CASE WHEN event_id % 2 = 0 THEN value ELSE CAST(user_id AS DOUBLE) END AS metric_value, CAST(ts AS DATE) AS day FROM events""")
def a6_metrics(t):
    root, named = folder(t, "rows"), F.col("event_id") % 2 == 0
    rows = t["events"].select(
        F.col("event_id").alias("id"), F.when(named, F.col("event_type")).alias("metric_name"), F.when(named, F.col("value")).alias("metric_value"),
        F.col("user_id").cast("double").alias("cpu_percent"), F.col("ts").alias("recorded_at"))
    W.append_rows(rows, root, "system_metrics")
    return t.spark.read.parquet(f"{root}/system_metrics").select("id", "metric_name", "metric_value", F.to_date("day").alias("day"))


@query("a6_alert_rows", "SELECT event_id AS alert_id, 'active' AS status, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'error'")
def a6_alerts(t):
    root = folder(t, "rows")
    W.append_rows(t.alerts().select("alert_id", "triggered_at"), root, "alerts")
    return t.spark.read.parquet(f"{root}/alerts").select("alert_id", "status", F.to_date("day").alias("day"))


@query("a6_other_rows", """SELECT 'application_metrics' AS kind, event_id AS id, CAST(ts AS DATE) AS day FROM events
UNION ALL SELECT 'performance_metrics', event_id, CAST(ts AS DATE) FROM events UNION ALL SELECT 'health_checks', event_id, CAST(ts AS DATE) FROM events""")
def a6_others(t):
    root, out = folder(t, "rows"), None
    for table in ("application_metrics", "performance_metrics", "health_checks"):
        W.append_rows(t["events"].select(F.col("event_id").alias("id"), F.col("ts").alias(W.LOG_TABLES[table])), root, table)
        stored = t.spark.read.parquet(f"{root}/{table}").select(F.lit(table).alias("kind"), "id", F.to_date("day").alias("day"))
        out = stored if out is None else out.unionByName(stored)
    return out


@query("a7_csv_export", """
SELECT CAST(data_id AS STRING) AS data_id, CASE WHEN ai_processed THEN 'True' ELSE 'False' END AS content_analysed, coalesce(title, 'None') AS content_title, concat_ws(', ', err_a, err_b) AS validation_errors FROM v_scraped_data WHERE confidence_score >= 0.5""", ["v_scraped_data"])
def a7(t):
    path = folder(t, "csv")
    # titles hold line breaks: one line per record needs them out of the way
    r = t.records_with_errors().withColumn("content", F.struct("title", F.col("ai_processed").alias("analysed")))
    one_line = r.withColumn("content", F.col("content").withField("title", F.replace("content.title", F.lit("\n"), F.lit("\\n"))))
    W.export(one_line, path, "csv", fields=["data_id", "content", "validation_errors"], min_confidence=0.5)
    back = t.spark.read.option("header", True).option("escape", '"').option("nullValue", "\u0001").option("emptyValue", "").csv(path)
    return back.select("data_id", "content_analysed", F.replace("content_title", F.lit("\\n"), F.lit("\n")).alias("content_title"), F.coalesce("validation_errors", F.lit("")).alias("validation_errors"))


@query("a8_json_export", "SELECT data_id, url, text FROM v_scraped_data WHERE job_id IN (1, 2, 3)", ["v_scraped_data"])
def a8(t):
    path = folder(t, "json")
    W.export(t.records(), path, "json", fields=["data_id", "url", "text"], job_ids=[1, 2, 3])
    return t.spark.read.schema("data_id bigint, url string, text string").json(path)


@query("a10_compressed_export", "SELECT data_id, url FROM v_scraped_data WHERE extracted_at >= TIMESTAMP '2024-01-02'", ["v_scraped_data"])
def a10(t):
    path = folder(t, "gz")
    W.export(t.records(), path, "json", fields=["data_id", "url", "extracted_at"], date_from="2024-01-02", compress=True, max_records=100, order_by="extracted_at")
    return t.spark.read.schema("data_id bigint, url string").json(path)


@query("a11_parquet_export", "SELECT data_id, title, content_length, extracted_at FROM v_scraped_data", ["v_scraped_data"])
def a11(t):
    path = folder(t, "parquet")
    W.export(t.records(), path, "parquet", fields=["data_id", "title", "content_length", "extracted_at"])
    return t.spark.read.parquet(path)


@query("a12_export_ledger", "SELECT 'completed' AS status, 'csv' AS format, count(*) AS records FROM v_scraped_data WHERE confidence_score >= 0.25 UNION ALL SELECT 'failed', 'json', NULL", ["v_scraped_data"])
def a12(t):
    ledger, out = folder(t, "ledger"), folder(t, "out")
    W.export(t.records(), out, "csv", fields=["data_id", "url"], user_id="u1", ledger=ledger, min_confidence=0.25)
    W.export(t.records(), out, "json", user_id="u1", ledger=ledger, date_from="2024-02-01", date_to="2024-01-01")
    return W.export_status(t.spark.read.parquet(ledger), "u1").select("status", "format", "records")


@query("a12_export_states", """
SELECT status, exports, records, has_size FROM (VALUES ('pending', 3, NULL, false), ('processing', 3, NULL, false), ('failed', 1, NULL, false)) x(status, exports, records, has_size)
UNION ALL SELECT 'completed', 2, (SELECT count(*) FROM v_scraped_data) + (SELECT count(*) FROM v_jobs), true""", ["v_scraped_data", "v_jobs"])
def a12b(t):
    """All states that three exports went through, with rows and sizes of those that ended well."""
    ledger = folder(t, "ledger")
    W.export(t.records(), folder(t, "out"), "parquet", user_id="u1", ledger=ledger)
    W.export(t.jobs(), folder(t, "out"), "json", user_id="u2", ledger=ledger)
    W.export(t.jobs(), folder(t, "out"), "json", user_id="u2", ledger=ledger, date_from="2024-02-01", date_to="2024-01-01")
    states = t.spark.read.parquet(ledger).groupBy("status")
    return states.agg(F.count(F.lit(1)).cast("int").alias("exports"), F.sum("records").alias("records"), F.coalesce(F.min(F.col("file_size") > 0), F.lit(False)).alias("has_size"))


@query("a9_report", "SELECT CAST(count(*) AS STRING) AS total FROM v_jobs", ["v_jobs"])
def a9(t):
    path = folder(t, "report")
    W.report(t.jobs().select("job_id", "status"), path)
    return t.spark.read.option("header", True).csv(f"{path}/summary").where("name = 'Total Records'").select(F.col("value").alias("total"))


@query("a14_jobs_export", "SELECT CAST(job_id AS STRING) AS job_id, status, CAST(priority AS STRING) AS priority FROM v_jobs", ["v_jobs"])
def a14(t):
    path = folder(t, "jobs")
    W.export(t.jobs(), path, "csv", fields=["job_id", "status", "priority"])
    return t.spark.read.option("header", True).csv(path)


@query("m4_chained_transforms", """
SELECT count(*) AS kept FROM (SELECT title, text FROM v_scraped_data WHERE confidence_score >= 0.5 GROUP BY title, text)""", ["v_scraped_data"])
def m4(t):
    """Operators are functions of a DataFrame, so callers chain their own with ``transform``."""
    out = t.records().transform(lambda df: df.where("confidence_score >= 0.5")).transform(O.keep_first, ["title", "text"], ["extracted_at", "data_id"])
    return out.agg(F.count(F.lit(1)).alias("kept"))
