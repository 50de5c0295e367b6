"""Streams drained into tables, compared with the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions.machines import SlidingLimit
from webloom.operators import events as E
from webloom.operators import maintain as M
from webloom.plans import events as PE
from webloom.plans.cleaning import strip_sql, text_value
from webloom.plans.maintain import folder
from webloom.plans.pages import PARTS
from webloom.plans.records import NOW
from webloom.plans.registry import ORACLE, query
from webloom.streaming import flows as S


def stream(t, name):
    return S.table_stream(t.spark, t.folder, name, t[name].schema)


class Streamed:
    """The tables of ``t`` with ``events`` read as a stream."""

    def __init__(self, t):
        self.t, self.spark, self.folder = t, t.spark, t.folder

    def __getitem__(self, name):
        return stream(self.t, name)

    def perf(self):
        return type(self.t).perf(self)


@query("k1_stream_ingest", f"WITH {PARTS} SELECT DISTINCT {text_value(strip_sql('title_raw'))} AS title, tx.text AS text FROM a JOIN tx USING (page_id)", ["v_pages"])
def k1(t):
    pages = stream(t, "pages").select("page_id", "url", F.col("html").alias("raw_html"))
    return S.drain(S.ingest(pages)).select("title", "text")


@query("k2_stream_limit")
def k2(t):
    e = PE.src(Streamed(t), 30)
    out = S.keyed(e, ["src"], "ts", "id", SlidingLimit(3, 43200), [S.AT], [("allowed", T.BooleanType()), ("retry_after", T.LongType())])
    return S.drain(out).select("id", "src", "allowed", "retry_after")


ORACLE["k2_stream_limit"] = ORACLE["k2_sliding_limit"]


@query("k7_stream_rollup", """
SELECT date_trunc('hour', recorded_at) AS window_start, count(*) AS jobs_processed, count(*) FILTER (WHERE NOT success) AS jobs_failed, round(count(*) FILTER (WHERE success)::DOUBLE / count(*) * 100, 6) AS success_rate, round(avg(duration_ms), 6) AS average_processing_time
FROM v_perf GROUP BY 1 HAVING date_trunc('hour', min(recorded_at)) + INTERVAL 1 HOUR <= (SELECT max(recorded_at) - INTERVAL 10 MINUTE FROM v_perf)""", ["v_perf"])
def k7(t):
    out = S.drain(S.rollup(Streamed(t).perf()))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "jobs_processed", "jobs_failed",
                      F.round("success_rate", 6).alias("success_rate"), F.round("average_processing_time", 6).alias("average_processing_time"))


#: A first delivery, and stragglers that come after it: whatever lies ten minutes behind the newest is late.
DELIVERED = """
s AS (SELECT *, metric_id % 10 >= 8 AND recorded_at < (SELECT max(recorded_at) FROM v_perf WHERE metric_id % 10 < 8) - INTERVAL 10 MINUTE AS is_late FROM v_perf)"""


def _deliveries(t):
    """Root of a roll-up that has read the events in two deliveries."""
    root, source = folder(t, "rollup"), folder(t, "arrivals")
    straggler = F.col("metric_id") % 10 >= 8
    perf = t.perf()
    for part in (perf.where(~straggler), perf.where(straggler)):
        part.write.mode("append").parquet(source)
        S.stored_rollup(S.file_stream(t.spark, source, "*.parquet", perf.schema), root)
    return root, perf.schema


@query("k7_stored_windows", f"""
WITH {DELIVERED}
SELECT date_trunc('hour', recorded_at) AS window_start, count(*) AS jobs_processed, count(*) FILTER (WHERE NOT success) AS jobs_failed, round(count(*) FILTER (WHERE success)::DOUBLE / count(*) * 100, 6) AS success_rate,
 round(avg(duration_ms), 6) AS average_processing_time, date_trunc('hour', min(recorded_at)) + INTERVAL 1 HOUR <= (SELECT max(recorded_at) - INTERVAL 10 MINUTE FROM v_perf) AS is_closed FROM s WHERE NOT is_late GROUP BY 1""", ["v_perf"])
def k7b(t):
    """All windows, open ones included, after two deliveries."""
    out = S.rollup_windows(t.spark, _deliveries(t)[0])
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "jobs_processed", "jobs_failed", F.round("success_rate", 6).alias("success_rate"),
                      F.round("average_processing_time", 6).alias("average_processing_time"), "is_closed")


@query("k7_late_rows", f"WITH {DELIVERED} SELECT metric_id, operation_name, recorded_at, CAST(1 AS BIGINT) AS batch FROM s WHERE is_late", ["v_perf"])
def k7c(t):
    late = S.late_rows(t.spark, *_deliveries(t))
    return late.select("metric_id", "operation_name", F.col("recorded_at").cast("timestamp_ntz").alias("recorded_at"), "batch")


EVENTS = {"view": "task-started", "click": "task-succeeded", "error": "task-failed", "purchase": "task-retried", "signup": "task-revoked"}


def tasks(src):
    names = F.create_map(*[x for k, v in EVENTS.items() for x in (F.lit(k), F.lit(v))])
    e = src["events"]
    return e.select((1 + F.col("user_id") * 4).alias("job_id"), names[F.col("event_type")].alias("event"), F.col("ts").alias("happened_at"),
                    F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 0, F.col("props")).alias("exception"), F.col("value").alias("runtime"))


@query("k8_job_lifecycle", """
WITH c AS (SELECT 1 + user_id * 4 AS job_id, ts, event_id, CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'retry' ELSE 'cancelled' END AS status,
 CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN props ELSE 'Unknown error' END END AS em FROM events),
g AS (SELECT job_id, arg_max(status, (ts, event_id)) AS s, max(ts) FILTER (WHERE status = 'running') AS st, arg_max(em, (ts, event_id)) FILTER (WHERE em IS NOT NULL) AS em, count(*) FILTER (WHERE status = 'retry') AS r FROM c GROUP BY 1)
SELECT j.job_id, coalesce(CASE WHEN s = 'retry' THEN 'pending' ELSE s END, j.status) AS status, coalesce(st, j.started_at) AS started_at, coalesce(g.em, j.error_message) AS error_message, CAST(j.retry_count + coalesce(r, 0) AS INT) AS retry_count FROM v_jobs j LEFT JOIN g ON g.job_id = j.job_id""", ["v_jobs"])
def k8(t):
    changes = S.drain(S.lifecycle(tasks(Streamed(t))))
    return M.apply_status(t.jobs(), changes).select("job_id", "status", "started_at", "error_message", "retry_count")


@query("k8_task_completions", """
SELECT event_id IS NOT NULL AS finished, event_type = 'click' AS success, CASE WHEN event_type = 'error' THEN 'TASK_FAILED' END AS error_type, count(*) AS tasks, round(sum(value), 4) AS processing_time FROM events WHERE event_type IN ('click', 'error') GROUP BY ALL""")
def k8b(t):
    rows = S.drain(S.completions(tasks(Streamed(t))))
    return rows.groupBy(F.lit(True).alias("finished"), "success", "error_type").agg(
        F.count(F.lit(1)).alias("tasks"), F.round(F.sum("processing_time"), 4).alias("processing_time"))


@query("k9_time_to_live", f"""
SELECT count(*) AS entries, count(*) FILTER (WHERE recorded_at >= TIMESTAMP '{NOW}' - INTERVAL 604800 SECOND) AS valid, count(*) FILTER (WHERE recorded_at < TIMESTAMP '{NOW}' - INTERVAL 604800 SECOND) AS expired FROM v_perf""", ["v_perf"])
def k9(t):
    return S.cache_stats(t.perf(), "recorded_at", "metric", NOW)


@query("k9_fresh_rows", f"SELECT metric_id FROM v_perf WHERE recorded_at >= TIMESTAMP '{NOW}' - INTERVAL 86400 SECOND", ["v_perf"])
def k9b(t):
    return S.fresh(t.perf(), "recorded_at", "job", NOW).select("metric_id")


@query("k10_stream_alerts")
def k10(t):
    metrics = PE._metrics(Streamed(t))
    out = E.threshold_alerts(metrics, PE.thresholds(t)).select("metric_id", "metric_name", "actual_value", "threshold_value", "severity")
    return S.drain(out)


ORACLE["k10_stream_alerts"] = ORACLE["e9_threshold_alerts"]


@query("a15_stream_append", "SELECT metric_id, operation_name, CAST(recorded_at AS DATE) AS day FROM v_perf", ["v_perf"])
def a15(t):
    root = folder(t, "stream")
    S.append_stream(Streamed(t).perf(), root, "performance_metrics", f"{root}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{root}/performance_metrics").select("metric_id", "operation_name", F.to_date("day").alias("day"))


ARRIVING = """
n AS (SELECT conv_id * 20 + turn AS data_id, conv_id * 97 AS job_id, role AS url, CAST(conv_id % 2 AS INT) AS part FROM conversations
  UNION ALL SELECT conv_id * 20 + turn, conv_id * 97 + 1, 'again', 1 FROM conversations WHERE conv_id % 4 = 0),
x AS (SELECT *, EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = n.job_id) AS has_job,
  min(part) OVER (PARTITION BY data_id) AS first_part FROM n),
judged AS (SELECT data_id, job_id, url, part, CASE WHEN url = 'again' AND EXISTS (SELECT 1 FROM x y WHERE y.data_id = x.data_id AND y.part = 0 AND y.has_job) THEN 'duplicate_id'
  WHEN NOT has_job THEN 'unknown_job' END AS reason FROM x)"""


def _arrivals(t):
    """Root and schema of records that came in two deliveries, the second with keys of the first and run twice."""
    root, source = folder(t, "checked"), folder(t, "arrivals")
    c = t["conversations"]
    rows = c.select((F.col("conv_id") * 20 + F.col("turn")).alias("data_id"), (F.col("conv_id") * 97).alias("job_id"),
                    F.lit(NOW).alias("extracted_at"), F.col("role").alias("url"), (F.col("conv_id") % 2).alias("part"))
    again = c.where("conv_id % 4 = 0").select((F.col("conv_id") * 20 + F.col("turn")).alias("data_id"), (F.col("conv_id") * 97 + 1).alias("job_id"),
                                              F.lit(NOW).alias("extracted_at"), F.lit("again").alias("url"), F.lit(1).alias("part"))
    jobs = t["orders"].select(F.col("o_orderkey").alias("job_id"))
    schema = rows.drop("part").schema
    for part in (0, 1):
        rows.unionByName(again).where(F.col("part") == part).drop("part").write.mode("append").parquet(source)
        S.append_checked(S.file_stream(t.spark, source, "*.parquet", schema), root, "crawl", jobs)
    # another stream that brings the same files again
    S.append_checked(S.file_stream(t.spark, source, "*.parquet", schema), root, "replay", jobs)
    return root, schema


@query("a15_checked_append", f"WITH {ARRIVING} SELECT DISTINCT data_id, job_id, url FROM judged WHERE reason IS NULL")
def a15c(t):
    """Records stored once each, whatever comes again."""
    return S.stored_records(t.spark, *_arrivals(t)).select("data_id", "job_id", "url")


@query("a15_rejected_rows", f"WITH {ARRIVING} SELECT DISTINCT data_id, job_id, url, reason FROM judged WHERE reason IS NOT NULL")
def a15d(t):
    rejected = S.stored_rejects(t.spark, *_arrivals(t)).where("stream = 'crawl'")
    return rejected.select("data_id", "job_id", "url", "reason")


@query("a15_stream_export", "SELECT doc_id, lang, CAST(length(text) AS INT) AS chars FROM documents")
def a15b(t):
    root = folder(t, "chunks")

    def write(rows, batch):
        rows.write.mode("overwrite").option("compression", "gzip").json(f"{root}/part={batch}")

    S.export_chunks(stream(t, "documents").select("doc_id", "lang", F.length("text").alias("chars")), write, f"{root}-checkpoint").awaitTermination()
    return t.spark.read.schema("doc_id bigint, lang string, chars int").option("basePath", root).json(f"{root}/part=*").select("doc_id", "lang", "chars")
