"""Queries over jobs and records: scans, filters, projections, pages, key joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.operators import records as R
from webloom.plans.registry import query

JOBS_NOW = "1998-12-31 00:00:00"
NOW = "2024-01-31 00:00:00"
ISO_SQL = "regexp_replace(strftime({c}, '%Y-%m-%dT%H:%M:%S.%f'), '[.]000000$', '')"


@query("a1_page_scan", "SELECT page_id, url, host, substr(raw_html, 1, 5000) AS raw_html, CAST(length(raw_html) AS BIGINT) AS html_chars FROM v_pages", ["v_pages"])
def a1(t):
    # only the stored copy is clipped; extraction always reads the whole page
    return t.pages().select(
        "page_id", "url", "host", F.substring("raw_html", 1, 5000).alias("raw_html"),
        F.length("raw_html").cast("long").alias("html_chars"),
    )


@query("a2_job_listing", f"""
SELECT job_id AS id, coalesce(name, 'Unnamed Job') AS name, url,
  CASE WHEN total_pages = 0 THEN 1 ELSE total_pages END AS max_pages, status,
  {ISO_SQL.format(c='created_at')} AS created_at, {ISO_SQL.format(c='started_at')} AS started_at,
  {ISO_SQL.format(c='completed_at')} AS completed_at,
  pages_completed, total_pages, error_message, retry_count, priority, user_id
FROM v_jobs ORDER BY v_jobs.created_at DESC""", ["v_jobs"])
def a2(t):
    return R.job_listing(t.jobs()).orderBy(F.desc("created_at"), "id")


@query("a3_point_lookup", "SELECT job_id, status, url FROM v_jobs WHERE job_id = 4711", ["v_jobs"])
def a3(t):
    return R.by_key(t.jobs(), "job_id", 4711).select("job_id", "status", "url")


@query("a5_append_check", """
SELECT data_id, job_id, CASE WHEN known THEN 'duplicate_id' WHEN j IS NULL THEN 'unknown_job' ELSE 'accepted' END AS outcome
FROM (SELECT c.conv_id * 20 + c.turn AS data_id, c.conv_id * 97 AS job_id, o.o_orderkey AS j,
        EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = c.conv_id * 20 + c.turn AND d.source = 'src1') AS known
      FROM conversations c LEFT JOIN orders o ON o.o_orderkey = c.conv_id * 97) x""")
def a5(t):
    new = t["conversations"].select(
        (F.col("conv_id") * 20 + F.col("turn")).alias("data_id"), (F.col("conv_id") * 97).alias("job_id"),
        F.lit(NOW).alias("extracted_at"), F.col("role").alias("url"),
    )
    existing = t["documents"].where("source = 'src1'").select(F.col("doc_id").alias("data_id"))
    jobs = t["orders"].select(F.col("o_orderkey").alias("job_id"))
    good, bad = R.accept_new(new, existing, jobs)
    cols = ["data_id", "job_id"]
    return good.select(*cols, F.lit("accepted").alias("outcome")).union(bad.select(*cols, F.col("reason").alias("outcome")))


# --- projections ---------------------------------------------------------------------------

@query("c1_field_selection", "SELECT data_id, url, title, CAST(length(text) AS BIGINT) AS n_chars FROM v_scraped_data", ["v_scraped_data"])
def c1(t):
    nested = t.records().select("data_id", "url", "content_length", F.struct("title", F.col("content_length").alias("n_chars")).alias("content"))
    return R.select_fields(nested, ["data_id", "url", "title", "n_chars", "no_such_field"])


@query("c2_drop_raw_html", "SELECT page_id, url, host FROM v_pages", ["v_pages"])
def c2(t):
    return R.without_raw_html(t.pages())


@query("c3_flatten", """
SELECT data_id, coalesce(title, 'None') AS content_title, CAST(content_length AS STRING) AS content_n_chars,
  CASE WHEN ai_processed THEN 'True' ELSE 'False' END AS content_analysed,
  concat_ws(', ', err_a, err_b) AS validation_errors,
  content_type AS meta_type, CASE WHEN err_a IS NOT NULL THEN err_a END AS meta_note
FROM v_scraped_data""", ["v_scraped_data"])
def c3(t):
    r = t.records_with_errors()
    note = F.array_contains("validation_errors", "missing_title")
    meta = F.when(note, F.create_map(F.lit("type"), F.col("content_type"), F.lit("note"), F.lit("missing_title"))) \
        .otherwise(F.create_map(F.lit("type"), F.col("content_type")))
    return R.flatten(r.select(
        "data_id",
        F.struct("title", F.col("content_length").alias("n_chars"), F.col("ai_processed").alias("analysed")).alias("content"),
        "validation_errors", meta.alias("meta"),
    ), {"meta": ["type", "note"]})


LISTING_SQL = f"""
SELECT r.data_id AS id, r.job_id, coalesce(j.name, 'Unknown') AS job_name, r.url, coalesce(r.title, 'No title') AS title,
  CASE WHEN length(r.text) > 200 THEN concat(substr(r.text, 1, 200), '...') ELSE r.text END AS content,
  {ISO_SQL.format(c='r.extracted_at')} AS scraped_at, strftime(r.extracted_at, '%Y-%m-%d') AS scraped_date,
  r.confidence_score, r.ai_processed, r.data_quality_score, r.content_length, r.content_type
FROM v_scraped_data r LEFT JOIN v_jobs j ON j.job_id = r.job_id"""


@query("c4_data_listing", LISTING_SQL, ["v_scraped_data", "v_jobs"])
def c4(t):
    return R.listing(t.records(), t.jobs())


@query("e1_record_job_name", "SELECT r.data_id, coalesce(j.name, 'Unknown') AS job_name FROM v_scraped_data r LEFT JOIN v_jobs j ON j.job_id = r.job_id", ["v_scraped_data", "v_jobs"])
def e1(t):
    return R.listing(t.records(), t.jobs()).select(F.col("id").alias("data_id"), "job_name")


@query("c5_table_display", """
SELECT data_id AS id, CASE WHEN length(url) > 50 THEN concat(substr(url, 1, 50), '...') ELSE url END AS url,
  strftime(extracted_at, '%Y-%m-%d %H:%M') AS extracted, confidence_score AS confidence, data_quality_score AS quality
FROM v_scraped_data""", ["v_scraped_data"])
def c5(t):
    return R.display(t.records())


@query("c6_job_progress", f"""
SELECT job_id, status, priority, CASE WHEN total_pages = 0 THEN 0.0 ELSE round(pages_completed::DOUBLE / total_pages::DOUBLE * 100.0, 2) END AS progress_percentage,
  CASE WHEN k THEN eta END AS eta_seconds,
  CASE WHEN k THEN TIMESTAMP '{JOBS_NOW}' + to_microseconds(CAST(round(eta * 1e6) AS BIGINT)) END AS estimated_completion
FROM (SELECT *, (status = 'running' AND started_at IS NOT NULL AND total_pages > 0 AND pages_completed > 0) AS k,
   round((epoch_us(TIMESTAMP '{JOBS_NOW}') - epoch_us(started_at)) / 1e6 / nullif(pages_completed, 0) * (total_pages - pages_completed), 3) AS eta
  FROM v_jobs)""", ["v_jobs"])
def c6(t):
    return R.progress(t.jobs(), JOBS_NOW)


@query("c7_record_conform", f"""
SELECT data_id, coalesce(title, '') AS title, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS content_length,
  (ai_processed OR confidence_score > 0) AS ai_processed,
  CASE WHEN ai_processed THEN TIMESTAMP '{NOW}' END AS processed_at FROM v_scraped_data""", ["v_scraped_data"])
def c7(t):
    return R.conform_records(t.records(), NOW).select("data_id", "title", "text", "content_length", "ai_processed", "processed_at")


@query("c8_job_conform", f"""
SELECT job_id, status, CASE WHEN status = 'running' THEN coalesce(started_at, TIMESTAMP '{JOBS_NOW}') ELSE started_at END AS started_at,
  CASE WHEN status = 'completed' THEN coalesce(completed_at, TIMESTAMP '{JOBS_NOW}') ELSE completed_at END AS completed_at
FROM v_jobs WHERE NOT (total_pages > 0 AND pages_completed > total_pages)""", ["v_jobs"])
def c8(t):
    return R.conform_jobs(t.jobs(), JOBS_NOW)[0].select("job_id", "status", "started_at", "completed_at")


@query("c10_content_preview", """
SELECT data_id, CASE WHEN length(title) > 1000 THEN concat(substr(title, 1, 1000), '...') ELSE title END AS title,
  CASE WHEN length(text) > 1000 THEN concat(substr(text, 1, 1000), '...') ELSE text END AS text FROM v_scraped_data""", ["v_scraped_data"])
def c10(t):
    content = F.create_map(F.lit("title"), F.col("title"), F.lit("text"), F.col("text"), F.lit("lang"), F.col("content_type"), F.lit("url"), F.col("url"))
    shown = R.preview(t.records().select("data_id", content.alias("content")))
    return shown.select("data_id", F.col("content")["title"].alias("title"), F.col("content")["text"].alias("text"))


# --- filters -------------------------------------------------------------------------------

@query("d1_record_filter", """
SELECT data_id, job_id, confidence_score FROM v_scraped_data
WHERE job_id = 7 AND confidence_score >= 0.3 AND data_quality_score >= 0.4""", ["v_scraped_data"])
def d1(t):
    found = R.filter_records(t.records(), job_ids=[7], min_confidence=0.3, min_quality=0.4)
    return found.select("data_id", "job_id", "confidence_score")


@query("d2_record_query", """
SELECT data_id, url, extracted_at, content_type FROM v_scraped_data
WHERE job_id IN (3, 4, 5, 6, 7, 8, 9) AND extracted_at >= TIMESTAMP '2024-01-01' AND extracted_at <= TIMESTAMP '2024-01-02 12:00:00'
  AND confidence_score >= 0.2 AND content_type = 'html' AND ai_processed = true
ORDER BY confidence_score DESC, data_id LIMIT 20""", ["v_scraped_data"])
def d2(t):
    found = R.filter_records(
        t.records(), job_ids=range(3, 10), date_from="2024-01-01", date_to="2024-01-02 12:00:00",
        min_confidence=0.2, content_type="html", ai_processed=True)
    return R.page(found, "confidence_score", "desc", 1, 20).select("data_id", "url", "extracted_at", "content_type")


@query("d3_export_filter", """
SELECT data_id, extracted_at, confidence_score FROM v_scraped_data
WHERE extracted_at >= TIMESTAMP '2024-01-01 12:00:00' AND extracted_at <= TIMESTAMP '2024-01-03' AND confidence_score >= 0.5""", ["v_scraped_data"])
def d3(t):
    return R.filter_records(t.records(), date_from="2024-01-01 12:00:00", date_to="2024-01-03", min_confidence=0.5) \
        .select("data_id", "extracted_at", "confidence_score")


@query("d4_url_like", "SELECT data_id, url FROM v_scraped_data WHERE url LIKE '%src1.example.com/en/%' ORDER BY extracted_at DESC, data_id LIMIT 100", ["v_scraped_data"])
def d4(t):
    return R.like_url(t.records(), "%src1.example.com/en/%").select("data_id", "url")


@query("d5_any_column_search", """
SELECT data_id, url FROM v_scraped_data WHERE contains(lower(concat_ws(chr(1), data_id, job_id, url, content_type, title, text)), 'tion the')""", ["v_scraped_data"])
def d5(t):
    return R.search_any(t.records().select("data_id", "job_id", "url", "content_type", "title", "text"), "Tion The").select("data_id", "url")


@query("d6_job_filter", """
SELECT job_id, status, priority, created_at FROM v_jobs WHERE status IN ('failed', 'running') AND priority <= 4
  AND created_at >= TIMESTAMP '1995-01-01' AND created_at <= TIMESTAMP '1996-12-31'""", ["v_jobs"])
def d6(t):
    return R.filter_jobs(t.jobs(), statuses=["failed", "running"], max_priority=4, start="1995-01-01", end="1996-12-31") \
        .select("job_id", "status", "priority", "created_at")


@query("d6_jobs_of_user", "SELECT job_id, status FROM v_jobs WHERE user_id = 42", ["v_jobs"])
def d6b(t):
    return R.filter_jobs(t.jobs(), user_id=42).select("job_id", "status")


@query("d7_time_cutoff", f"SELECT metric_id, operation_name, recorded_at FROM v_perf WHERE recorded_at >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND operation_name = 'op_3'", ["v_perf"])
def d7(t):
    return R.recent(t.perf(), "recorded_at", NOW, hours=24).where("operation_name = 'op_3'").select("metric_id", "operation_name", "recorded_at")


@query("d7_log_level", "SELECT log_id, job_id, message FROM v_job_logs WHERE level = 'ERROR'", ["v_job_logs"])
def d7b(t):
    return t.job_logs().where("level = 'ERROR'").select("log_id", "job_id", "message")


@query("d8_records_with_errors", "SELECT data_id, concat_ws(', ', err_a, err_b) AS errors FROM v_scraped_data WHERE coalesce(err_a, err_b) IS NOT NULL", ["v_scraped_data"])
def d8(t):
    return R.filter_records(t.records_with_errors(), has_errors=True).select("data_id", F.array_join("validation_errors", ", ").alias("errors"))


@query("d9_active_alerts", "SELECT alert_id, severity, triggered_at FROM v_alerts WHERE status = 'active' AND severity = 'high'", ["v_alerts"])
def d9(t):
    return R.active_alerts(t.alerts(), "high").select("alert_id", "severity", "triggered_at")


@query("d12_active_jobs", "SELECT job_id, status, priority FROM v_jobs WHERE status IN ('pending', 'running') ORDER BY priority, created_at, job_id LIMIT 100", ["v_jobs"])
def d12(t):
    return R.active_jobs(t.jobs(), 100).select("job_id", "status", "priority")


# --- key joins -----------------------------------------------------------------------------

@query("e2_cascade_delete", """
SELECT 'records' AS child, count(*) AS kept FROM v_scraped_data WHERE job_id NOT IN (SELECT job_id FROM v_jobs WHERE status = 'failed')
UNION ALL SELECT 'logs', count(*) FROM v_job_logs WHERE job_id NOT IN (SELECT job_id FROM v_jobs WHERE status = 'failed')""", ["v_scraped_data", "v_jobs", "v_job_logs"])
def e2(t):
    gone = R.filter_jobs(t.jobs(), statuses=["failed"])
    records, logs = R.cascade_delete(gone, t.records(), t.job_logs())
    return records.agg(F.count(F.lit(1)).alias("kept")).select(F.lit("records").alias("child"), "kept") \
        .union(logs.agg(F.count(F.lit(1)).alias("kept")).select(F.lit("logs"), "kept"))


@query("e3_foreign_key", "SELECT c.c_custkey AS data_id FROM customer c WHERE EXISTS (SELECT 1 FROM v_jobs j WHERE j.job_id = c.c_custkey * 11)", ["v_jobs"])
def e3(t):
    rows = t["customer"].select(F.col("c_custkey").alias("data_id"), (F.col("c_custkey") * 11).alias("job_id"))
    return R.with_parent(rows, t.jobs()).select("data_id")


@query("e4_batch_outcome", """
SELECT CASE WHEN j.job_id IS NULL THEN 'not_found' ELSE 'success' END AS status, count(*) AS items
FROM (SELECT p_partkey * 13 AS job_id FROM part) i LEFT JOIN v_jobs j ON j.job_id = i.job_id GROUP BY 1""", ["v_jobs"])
def e4(t):
    ids = t["part"].select((F.col("p_partkey") * 13).alias("job_id"))
    return R.batch_outcome(ids, t.jobs(), "cancel").groupBy("status").agg(F.count(F.lit(1)).alias("items"))


@query("n3_legal_transitions", """
SELECT i.job_id, i.operation FROM (SELECT p_partkey * 7 AS job_id, CASE WHEN p_size % 2 = 0 THEN 'cancel' ELSE 'retry' END AS operation FROM part) i
JOIN v_jobs j ON j.job_id = i.job_id
WHERE (operation = 'cancel' AND status NOT IN ('completed', 'failed', 'cancelled')) OR (operation = 'retry' AND status = 'failed')""", ["v_jobs"])
def n3(t):
    asked = t["part"].select((F.col("p_partkey") * 7).alias("job_id"), F.when(F.col("p_size") % 2 == 0, "cancel").otherwise("retry").alias("operation"))
    return R.legal_transitions(asked, t.jobs()).select("job_id", "operation")


# --- order and pages -----------------------------------------------------------------------

@query("h1_order_limit_offset", "SELECT data_id, extracted_at FROM v_scraped_data ORDER BY extracted_at DESC, data_id LIMIT 50 OFFSET 100", ["v_scraped_data"])
def h1(t):
    return R.page(t.records(), "extracted_at", "desc", 3, 50).select("data_id", "extracted_at")


@query("h2_page_envelope", "SELECT CAST(3 AS BIGINT) AS page, CAST(50 AS BIGINT) AS page_size, count(*) AS total, 150 < count(*) AS has_next, true AS has_previous FROM v_jobs WHERE status = 'running'", ["v_jobs"])
def h2(t):
    return R.page_info(R.filter_jobs(t.jobs(), statuses=["running"]), 3, 50)


@query("h2_keyset_page", """
SELECT job_id, created_at FROM v_jobs WHERE created_at < TIMESTAMP '1996-06-01' OR (created_at = TIMESTAMP '1996-06-01' AND job_id > 100)
ORDER BY created_at DESC, job_id LIMIT 50""", ["v_jobs"])
def h2b(t):
    return R.page_after(t.jobs(), "created_at", "1996-06-01", 100, 50, "job_id").select("job_id", "created_at")


@query("h3_dynamic_sort", "SELECT data_id, content_length FROM v_scraped_data ORDER BY content_length ASC, data_id LIMIT 25", ["v_scraped_data"])
def h3(t):
    return R.page(t.records(), "content_length", "asc", 1, 25).select("data_id", "content_length")


@query("h4_priority_order", "SELECT job_id, priority, created_at FROM v_jobs WHERE status = 'pending' ORDER BY priority, created_at", ["v_jobs"])
def h4(t):
    return R.filter_jobs(t.jobs(), statuses=["pending"]).orderBy("priority", "created_at").select("job_id", "priority", "created_at")


@query("h6_recent_jobs", "SELECT job_id, created_at FROM v_jobs ORDER BY created_at DESC, job_id LIMIT 5", ["v_jobs"])
def h6(t):
    return R.newest(t.jobs(), "created_at", 5, "job_id").select("job_id", "created_at")


@query("h6_recent_records", "SELECT data_id, url FROM v_scraped_data ORDER BY extracted_at DESC, data_id LIMIT 20", ["v_scraped_data"])
def h6b(t):
    return R.newest(t.records(), "extracted_at", 20, "data_id").select("data_id", "url")
