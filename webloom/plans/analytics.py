"""Aggregate queries over jobs, records and performance events."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.functions.urls import host
from webloom.operators import analytics as A
from webloom.operators import records as R
from webloom.plans.maintain import folder
from webloom.plans.records import JOBS_NOW, NOW
from webloom.plans.registry import query

PERF_DAY = f"recorded_at >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR"
DUR = "(epoch_us(completed_at) - epoch_us(started_at)) / 1e6"


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("f1_job_counts", "SELECT status, count(*) AS jobs FROM v_jobs WHERE created_at >= TIMESTAMP '1994-01-01' AND created_at <= TIMESTAMP '1997-01-01' GROUP BY status", ["v_jobs"])
def f1(t):
    return A.job_counts(R.filter_jobs(t.jobs(), start="1994-01-01", end="1997-01-01"))


@query("e8_status_zero_fill", """
SELECT s.status, count(j.job_id) AS jobs FROM (VALUES ('pending'), ('running'), ('completed'), ('failed'), ('cancelled')) s(status)
LEFT JOIN v_jobs j ON j.status = s.status GROUP BY s.status""", ["v_jobs"])
def e8(t):
    return A.status_counts_filled(t.jobs())


@query("f2_job_performance", f"""
SELECT coalesce(round(avg(total_pages), 6), 0.0) AS avg_pages, CAST(coalesce(sum(total_pages), 0) AS BIGINT) AS total_pages,
  coalesce(round(avg({DUR}), 6), 0.0) AS avg_duration_seconds FROM v_jobs WHERE status = 'completed'""", ["v_jobs"])
def f2(t):
    return rounded(A.job_performance(t.jobs()), "avg_pages", "avg_duration_seconds")


@query("f3_quality_metrics", """
SELECT round(avg(confidence_score), 6) AS avg_confidence, round(avg(data_quality_score), 6) AS avg_quality, count(*) AS total_records,
  round(100.0::DOUBLE * count(*) FILTER (WHERE ai_processed) / count(*), 6) AS ai_processed_percent,
  round(avg(n) FILTER (WHERE n > 0), 6) AS avg_validation_errors
FROM (SELECT *, (err_a IS NOT NULL)::INT + (err_b IS NOT NULL)::INT AS n FROM v_scraped_data)""", ["v_scraped_data"])
def f3(t):
    return rounded(A.quality_metrics(t.records_with_errors()), "avg_confidence", "avg_quality", "ai_processed_percent", "avg_validation_errors")


@query("f6_hourly_history", f"""
SELECT date_trunc('hour', recorded_at) AS hour, count(*) AS jobs_processed, count(*) FILTER (WHERE NOT success) AS jobs_failed,
  round(count(*) FILTER (WHERE success)::DOUBLE / count(*) * 100, 6) AS success_rate, round(avg(duration_ms), 6) AS average_processing_time
FROM v_perf WHERE {PERF_DAY} GROUP BY 1""", ["v_perf"])
def f6(t):
    return rounded(A.hourly_history(t.perf(), NOW, 24), "success_rate", "average_processing_time")


@query("f7_throughput", f"""
SELECT round(count(*) / 2.0, 6) AS throughput, round(coalesce(avg(duration_ms), 0), 6) AS avg_processing_time
FROM v_perf WHERE recorded_at >= TIMESTAMP '{NOW}' - INTERVAL 120 MINUTE""", ["v_perf"])
def f7(t):
    return rounded(A.throughput(t.perf(), NOW, 120), "throughput", "avg_processing_time")


@query("f8_error_rate", f"SELECT round(avg(CASE WHEN success THEN 0.0::DOUBLE ELSE 100.0 END), 6) AS error_rate FROM v_perf WHERE {PERF_DAY}", ["v_perf"])
def f8(t):
    return rounded(A.error_rate(t.perf(), NOW, 24), "error_rate")


@query("f9_errors_by_type", f"""
SELECT error_type, count(*) AS errors FROM v_perf WHERE NOT success AND error_type IS NOT NULL
  AND recorded_at >= TIMESTAMP '{NOW}' - INTERVAL 10000 MINUTE GROUP BY error_type""", ["v_perf"])
def f9(t):
    return A.errors_by_type(t.perf(), NOW, 10000)


@query("f10_metrics_summary", f"""
SELECT s.*, a.*, p.*, x.* FROM
 (SELECT round(avg(value), 2) AS avg_cpu_percent, round(avg(user_id), 2) AS avg_memory_percent, count(*) AS system_points FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '{NOW}' - INTERVAL 240 HOUR) s,
 (SELECT count(*) AS application_points FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '{NOW}' - INTERVAL 240 HOUR) a,
 (SELECT count(*) AS total_operations, round(count(*) FILTER (WHERE success)::DOUBLE / count(*) * 100, 2) AS success_rate_percent, round(avg(duration_ms), 2) AS avg_response_time_ms
  FROM v_perf WHERE recorded_at >= TIMESTAMP '{NOW}' - INTERVAL 240 HOUR) p,
 (SELECT count(*) AS active_alerts FROM v_alerts WHERE status = 'active') x""", ["v_perf", "v_alerts"])
def f10(t):
    e = t["events"].withColumnRenamed("ts", "recorded_at")
    system = e.where("event_type = 'view'").select("recorded_at", F.col("value").alias("cpu_percent"), F.col("user_id").cast("double").alias("memory_percent"))
    return A.metrics_summary(system, e.where("event_type = 'click'"), t.perf(), t.alerts(), NOW, 240)


@query("f11_application_snapshot", """
SELECT (SELECT count(*) FROM v_perf) AS total_requests, (SELECT count(*) FROM v_perf WHERE error_type IS NOT NULL AND NOT success) AS total_errors,
 (SELECT round(avg(duration_ms), 6) FROM (SELECT duration_ms FROM v_perf WHERE success ORDER BY recorded_at DESC, metric_id DESC LIMIT 100)) AS avg_response_time_ms,
 (SELECT round(100.0::DOUBLE * count(*) FILTER (WHERE error_type IS NOT NULL AND NOT success) / count(*), 6) FROM v_perf) AS error_rate_percent""", ["v_perf"])
def f11(t):
    return rounded(A.application_snapshot(t.perf()), "avg_response_time_ms", "error_rate_percent")


RET = {"scraped_data": 20, "job_logs": 90, "alerts": 10, "performance_metrics": 14}


def _retention_sql(name, view, ts, days):
    cut = f"TIMESTAMP '{NOW}' - INTERVAL {days} DAY"
    return f"""SELECT '{name}' AS data_type, CAST({days} AS BIGINT) AS retention_days, count(*) AS total_records,
 count(*) FILTER (WHERE {ts} < {cut}) AS expired_records, count(*) - count(*) FILTER (WHERE {ts} < {cut}) AS active_records,
 min({ts}) AS oldest_record, max({ts}) AS newest_record, {cut} AS cutoff_date FROM {view}"""


@query("f12_retention_summary", " UNION ALL ".join([
    _retention_sql("scraped_data", "v_scraped_data", "extracted_at", 20),
    _retention_sql("alerts", "v_alerts", "triggered_at", 10),
    _retention_sql("performance_metrics", "v_perf", "recorded_at", 14)]), ["v_scraped_data", "v_alerts", "v_perf"])
def f12(t):
    tables = {"scraped_data": (t.records(), "extracted_at"), "alerts": (t.alerts(), "triggered_at"), "performance_metrics": (t.perf(), "recorded_at")}
    return A.retention_summary(tables, RET, NOW)


@query("f13_storage_usage", """
SELECT 'scraped_data' AS data_type, count(*) AS record_count, round(count(*) * 0.001::DOUBLE, 3) AS estimated_size_mb FROM v_scraped_data
UNION ALL SELECT 'job_logs', count(*), round(count(*) * 0.001::DOUBLE, 3) FROM v_job_logs""", ["v_scraped_data", "v_job_logs"])
def f13(t):
    return A.storage_usage({"scraped_data": t.records(), "job_logs": t.job_logs()})


@query("f14_data_summary", """
SELECT count(*) AS total_records, count(DISTINCT job_id) AS total_jobs, round(avg(confidence_score), 6) AS avg_confidence,
 min(extracted_at) AS first_extracted, max(extracted_at) AS last_extracted, count(*) FILTER (WHERE confidence_score >= 0.8) AS high_confidence,
 count(*) FILTER (WHERE ai_processed) AS ai_processed, count(*) FILTER (WHERE coalesce(err_a, err_b) IS NOT NULL) AS with_errors,
 (SELECT string_agg(concat(content_type, ':', CAST(n AS STRING)), ',' ORDER BY n DESC, content_type) FROM (SELECT content_type, count(*) AS n FROM v_scraped_data GROUP BY 1)) AS content_types FROM v_scraped_data""", ["v_scraped_data"])
def f14(t):
    kinds = F.transform("content_types", lambda x: F.concat(x["content_type"], F.lit(":"), x["records"].cast("string")))
    return rounded(A.data_summary(t.records_with_errors()), "avg_confidence").withColumn("content_types", F.array_join(kinds, ","))


@query("f15_job_stats", f"""
SELECT count(*) AS total_jobs, count(*) FILTER (WHERE status='pending') AS pending_jobs, count(*) FILTER (WHERE status='running') AS running_jobs,
 count(*) FILTER (WHERE status='completed') AS completed_jobs, count(*) FILTER (WHERE status='failed') AS failed_jobs, count(*) FILTER (WHERE status='cancelled') AS cancelled_jobs,
 round(avg({DUR}) FILTER (WHERE status='completed'), 6) AS avg_completion_seconds,
 round(count(*) FILTER (WHERE status='completed')::DOUBLE / count(*) FILTER (WHERE status IN ('completed','failed')) * 100, 6) AS success_rate,
 round(sum(pages_completed) FILTER (WHERE status='completed' AND started_at IS NOT NULL)::DOUBLE / (sum({DUR}) FILTER (WHERE status='completed') / 60), 9) AS pages_per_minute,
 (SELECT round(avg(data_quality_score), 6) FROM v_scraped_data) AS avg_quality
FROM v_jobs""", ["v_jobs", "v_scraped_data"])
def f15(t):
    return rounded(rounded(A.job_stats(t.jobs(), t.records()), "avg_completion_seconds", "success_rate", "avg_quality"), "pages_per_minute", digits=9)


@query("f15_common_errors", "SELECT error_message, count(*) AS rows FROM v_jobs WHERE error_message IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3", ["v_jobs"])
def f15b(t):
    return A.common_errors(t.jobs(), 3)


@query("f16_top_domains", """
WITH c AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS domain, count(*) AS n FROM pages GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, domain) AS rk FROM c)
SELECT CASE WHEN rk <= 10 THEN domain ELSE 'other' END AS domain, CAST(sum(n) AS BIGINT) AS records FROM r GROUP BY 1""")
def f16(t):
    return A.top_domains(t.pages(), 10)


@query("f17_content_types", "SELECT content_type, count(*) AS records, round(avg(data_quality_score), 6) AS avg_quality FROM v_scraped_data GROUP BY 1", ["v_scraped_data"])
def f17(t):
    return rounded(A.by_content_type(t.records()), "avg_quality")


def _hist(score):
    return f"SELECT concat('0.', CAST(CAST(least(floor(round({score} * 10, 9)), 9) AS INT) AS STRING)) AS bin, count(*) AS records FROM v_scraped_data GROUP BY 1"


@query("f18_confidence_histogram", _hist("confidence_score"), ["v_scraped_data"])
def f18(t):
    return A.score_histogram(t.records(), "confidence_score")


@query("f18_quality_histogram", _hist("data_quality_score"), ["v_scraped_data"])
def f18b(t):
    return A.score_histogram(t.records(), "data_quality_score")


@query("f19_daily_volume", """
SELECT CAST(date_trunc('day', extracted_at) AS TIMESTAMP) AS period, count(*) AS count, count(*) FILTER (WHERE coalesce(err_a, err_b) IS NULL) AS success_count,
 count(*) FILTER (WHERE coalesce(err_a, err_b) IS NOT NULL) AS error_count FROM v_scraped_data GROUP BY 1""", ["v_scraped_data"])
def f19(t):
    return A.volume(t.records_with_errors(), "day", F.size("validation_errors") > 0)


@query("f19_hourly_volume", """
SELECT s.period, count(e.ts) AS count, count(*) FILTER (WHERE e.event_type <> 'error') AS success_count, count(*) FILTER (WHERE e.event_type = 'error') AS error_count
FROM (SELECT unnest(generate_series(TIMESTAMP '2023-12-31', TIMESTAMP '2024-02-01', INTERVAL 1 HOUR)) AS period) s
LEFT JOIN events e ON date_trunc('hour', e.ts) = s.period GROUP BY 1""")
def f19b(t):
    return A.volume(t["events"], "hour", F.col("event_type") == "error", "ts", "2023-12-31", "2024-02-01")


@query("f20_quality_trend", "SELECT CAST(extracted_at AS DATE) AS day, round(avg(data_quality_score), 6) AS avg_quality FROM v_scraped_data GROUP BY 1", ["v_scraped_data"])
def f20(t):
    return rounded(A.quality_trend(t.records()).select("day", "avg_quality"), "avg_quality")


@query("g2_period_delta", """
WITH d AS (SELECT CAST(extracted_at AS DATE) AS day, avg(data_quality_score) AS avg_quality, avg(confidence_score) AS avg_confidence, avg(ai_processed::INT::DOUBLE) AS ai_share, count(*) AS records FROM v_scraped_data GROUP BY 1)
SELECT day, records, records - lag(records) OVER (ORDER BY day) AS records_delta, round(avg_quality - lag(avg_quality) OVER (ORDER BY day), 6) AS avg_quality_delta,
 round(avg_confidence - lag(avg_confidence) OVER (ORDER BY day), 6) AS avg_confidence_delta, round(ai_share - lag(ai_share) OVER (ORDER BY day), 6) AS ai_share_delta FROM d""", ["v_scraped_data"])
def g2(t):
    out = A.deltas(A.quality_trend(t.records()), "day", ["records", "avg_quality", "avg_confidence", "ai_share"])
    return rounded(out.drop("avg_quality", "avg_confidence", "ai_share"), "avg_quality_delta", "avg_confidence_delta", "ai_share_delta")


@query("f21_error_counts", """
SELECT error_type, count(*) AS errors FROM (SELECT err_a AS error_type FROM v_scraped_data UNION ALL SELECT err_b FROM v_scraped_data) WHERE error_type IS NOT NULL GROUP BY 1""", ["v_scraped_data"])
def f21(t):
    return A.error_counts(t.records_with_errors())


@query("f21_error_share", """
SELECT count(err_a) + count(err_b) AS errors, count(*) FILTER (WHERE coalesce(err_a, err_b) IS NOT NULL) AS records_with_errors,
 round(count(*) FILTER (WHERE coalesce(err_a, err_b) IS NOT NULL)::DOUBLE / count(*) * 100, 6) AS error_rate FROM v_scraped_data""", ["v_scraped_data"])
def f21b(t):
    return rounded(A.error_share(t.records_with_errors()), "error_rate").withColumn("errors", F.col("errors").cast("long"))


@query("f22_job_history", """
SELECT count(*) AS total_jobs, count(*) FILTER (WHERE status = 'running') AS running_jobs, round(count(*) FILTER (WHERE status = 'completed')::DOUBLE / count(*) * 100, 6) AS success_rate,
 CAST(sum(pages_completed) AS BIGINT) AS pages, round(avg(pages_completed), 6) AS avg_pages FROM v_jobs""", ["v_jobs"])
def f22(t):
    return rounded(A.job_history(t.jobs()), "success_rate", "avg_pages")


@query("f23_active_summary", """
SELECT 'total' AS dimension, 'active' AS value, count(*) AS jobs FROM v_jobs WHERE status IN ('pending', 'running')
UNION ALL SELECT 'status', status, count(*) FROM v_jobs WHERE status IN ('pending', 'running') GROUP BY status
UNION ALL SELECT 'priority', CAST(priority AS STRING), count(*) FROM v_jobs WHERE status IN ('pending', 'running') GROUP BY priority""", ["v_jobs"])
def f23(t):
    return A.active_summary(t.jobs())


@query("f24_run_result", """
WITH r AS (SELECT job_id, count(*) AS n, avg(confidence_score) AS c FROM v_scraped_data GROUP BY job_id)
SELECT j.job_id, coalesce(n, 0) AS pages_scraped, CAST(j.pages_failed AS BIGINT) AS pages_failed, round(coalesce(c, 0.0), 6) AS average_confidence,
 CASE WHEN coalesce(n, 0) + j.pages_failed = 0 THEN 0.0 ELSE round(coalesce(n, 0)::DOUBLE / (coalesce(n, 0) + j.pages_failed), 6) END AS success_rate, coalesce(n, 0) > 0 AS success
FROM v_jobs j FULL JOIN r ON r.job_id = j.job_id WHERE j.job_id IS NOT NULL
UNION ALL SELECT r.job_id, n, 0, round(c, 6), 1.0, true FROM r WHERE r.job_id NOT IN (SELECT job_id FROM v_jobs)""", ["v_jobs", "v_scraped_data"])
def f24(t):
    return rounded(A.run_result(t.records(), t.jobs()), "average_confidence", "success_rate")


@query("f25_endpoint_rates", """
SELECT operation_name AS endpoint, date_trunc('minute', recorded_at) AS period, count(*) AS throughput,
 round(count(*) FILTER (WHERE NOT success)::DOUBLE / count(*), 4) AS error_rate, count(*) FILTER (WHERE duration_ms > 20) AS slow_requests FROM v_perf GROUP BY 1, 2""", ["v_perf"])
def f25(t):
    return A.endpoint_rates(t.perf(), 20.0)


@query("f28_historical_means", """
SELECT round(avg(value), 6) AS avg_value, round(avg(user_id), 6) AS avg_user_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20'""")
def f28(t):
    return rounded(A.historical_means(t["events"], "ts", "2024-01-10", "2024-01-20", ["value", "user_id"]), "avg_value", "avg_user_id")


@query("f29_sources", """
SELECT count(*) AS records, count(DISTINCT regexp_extract(url, '^https?://([^/]+)', 1)) AS sources, round(avg(data_quality_score), 6) AS avg_quality, round(avg(confidence_score), 6) AS avg_confidence FROM v_scraped_data""", ["v_scraped_data"])
def f29(t):
    return rounded(A.sources(t.records()), "avg_quality", "avg_confidence")


@query("f29_merged_users", """
SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS rows, count(DISTINCT user_id) AS users, true AS estimate_holds FROM events GROUP BY 1""")
def f29b(t):
    """Distinct users per week from stored sketches of days, held against the exact count (three standard deviations)."""
    events, week = t["events"], F.date_trunc("week", "day").cast("date").alias("week")
    path = folder(t, "sketches")
    A.source_sketches(events, "ts", F.col("user_id")).write.parquet(path)
    merged = A.merged_distinct(t.spark.read.parquet(path), week)
    exact = events.groupBy(F.date_trunc("week", "ts").cast("date").alias("week")).agg(F.countDistinct("user_id").alias("users"))
    holds = F.abs(F.col("distinct_values") - F.col("users")) <= F.greatest(F.lit(0.5), F.col("users") * 3 * A.SKETCH_ERROR)
    return merged.join(exact, "week").select("week", "rows", "users", holds.alias("estimate_holds"))


@query("f29_merged_sources", """
SELECT count(*) AS rows, count(DISTINCT regexp_extract(url, '^https?://([^/]+)', 1)) AS sources FROM v_scraped_data""", ["v_scraped_data"])
def f29c(t):
    """All sources from the stored sketches of days; so few are counted exactly."""
    path = folder(t, "sketches")
    A.source_sketches(t.records(), "extracted_at", A.host("url")).write.parquet(path)
    return A.merged_distinct(t.spark.read.parquet(path)).select("rows", F.col("distinct_values").alias("sources"))


@query("f31_slow_operations", """
SELECT operation_name, count(*) AS calls, round(sum(duration_ms), 4) AS total_ms, round(avg(duration_ms), 6) AS mean_ms, max(duration_ms) AS max_ms FROM v_perf GROUP BY 1 ORDER BY avg(duration_ms) DESC LIMIT 3""", ["v_perf"])
def f31(t):
    return rounded(A.slow_operations(t.perf(), 3), "mean_ms").withColumn("total_ms", F.round("total_ms", 4))


@query("f32_facets", """
SELECT DISTINCT 'job' AS facet, CAST(job_id AS STRING) AS value FROM v_scraped_data
UNION SELECT DISTINCT 'domain', regexp_extract(url, '^https?://([^/]+)', 1) FROM v_scraped_data""", ["v_scraped_data"])
def f32(t):
    return A.facets(t.records(), {"job": F.col("job_id"), "domain": host("url")})


VAL = """
WITH x AS (SELECT trim(coalesce(title, '')) = '' OR trim(coalesce(text, '')) = '' AS m, coalesce(confidence_score, 0) < 0.5 AS l FROM v_scraped_data)"""


@query("f33_validation_run", VAL + """
SELECT count(*) AS total_records_checked, count(*) FILTER (WHERE NOT (m OR l)) AS validation_passed, count(*) FILTER (WHERE m OR l) AS validation_failed,
 round(count(*) FILTER (WHERE NOT (m OR l))::DOUBLE / count(*), 6) AS quality_score, count(*) FILTER (WHERE m) AS missing_content, count(*) FILTER (WHERE l) AS low_confidence FROM x""", ["v_scraped_data"])
def f33(t):
    return rounded(A.validate_run(t.records()), "quality_score")


@query("f33_validation_issues", VAL + """
SELECT 'low_confidence' AS type, count(*) FILTER (WHERE l) AS count, 'low' AS severity FROM x HAVING count(*) FILTER (WHERE l) > 0
UNION ALL SELECT 'missing_content', count(*) FILTER (WHERE m), 'medium' FROM x HAVING count(*) FILTER (WHERE m) > 0""", ["v_scraped_data"])
def f33b(t):
    return A.run_issues(A.validate_run(t.records())).select("type", "count", "severity")


@query("e11_job_detail", """
WITH l AS (SELECT job_id, count(*) AS n, max(log_id) AS m FROM v_job_logs GROUP BY 1),
r AS (SELECT job_id, count(*) AS n, avg(data_quality_score) AS q, avg(CASE WHEN coalesce(err_a, err_b) IS NULL THEN 1.0::DOUBLE ELSE 0 END) AS s FROM v_scraped_data GROUP BY 1),
p AS (SELECT client_id * 4 AS job_id, avg(duration_ms / 1000) AS load FROM v_perf GROUP BY 1)
SELECT j.job_id, j.status, coalesce(l.n, 0) AS log_lines, l.m AS latest_log, coalesce(r.n, 0) AS records, round(coalesce(q, 0.0), 6) AS quality, round(coalesce(s, 0.0), 6) AS success_rate, round(p.load, 6) AS average_load_seconds
FROM v_jobs j LEFT JOIN l ON l.job_id = j.job_id LEFT JOIN r ON r.job_id = j.job_id LEFT JOIN p ON p.job_id = j.job_id""", ["v_jobs", "v_job_logs", "v_scraped_data", "v_perf"])
def e11(t):
    loads = t.perf().select((F.col("client_id") * 4).alias("job_id"), (F.col("duration_ms") / 1000).alias("load_seconds"))
    return rounded(A.job_detail(t.jobs(), t.job_logs(), t.records_with_errors(), loads), "quality", "success_rate", "average_load_seconds")


@query("e11_job_log_lines", "SELECT log_id, level, message FROM v_job_logs WHERE job_id = 12", ["v_job_logs"])
def e11b(t):
    return A.job_log_lines(t.job_logs(), 12).select("log_id", "level", "message")


@query("g6_latest_snapshot", """
SELECT client_id, metric_id, operation_name, duration_ms FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY recorded_at DESC, metric_id DESC) AS rn FROM v_perf) WHERE rn = 1""", ["v_perf"])
def g6(t):
    return A.latest(t.perf(), "client_id", "recorded_at", "metric_id").select("client_id", "metric_id", "operation_name", "duration_ms")


@query("g7_bounded_history", """
SELECT metric_id, operation_name FROM (SELECT *, row_number() OVER (PARTITION BY operation_name ORDER BY recorded_at DESC, metric_id DESC) AS rn FROM v_perf) WHERE rn <= 500""", ["v_perf"])
def g7(t):
    return A.last_n(t.perf(), "operation_name", "recorded_at", "metric_id", 500).select("metric_id", "operation_name")


@query("h5_top_errors", "SELECT error_type, count(*) AS rows FROM v_perf WHERE error_type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2", ["v_perf"])
def h5(t):
    return A.top_k(t.perf().where("error_type IS NOT NULL"), "error_type", 2)


@query("i2_stacked_histories", """
SELECT 'alerts' AS category, count(*) AS n, count(severity) AS with_severity, count(duration_ms) AS with_duration FROM (SELECT severity, NULL AS duration_ms FROM v_alerts)
UNION ALL SELECT 'performance', count(*), 0, count(duration_ms) FROM v_perf""", ["v_alerts", "v_perf"])
def i2(t):
    stacked = A.stack_histories(performance=t.perf(), alerts=t.alerts())
    return stacked.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count("severity").alias("with_severity"), F.count("duration_ms").alias("with_duration"))


@query("f7_sliding_rates", """
WITH w AS (SELECT recorded_at, success, duration_ms, unnest(generate_series(0, 11)) AS k FROM v_perf)
SELECT time_bucket(INTERVAL 5 MINUTE, recorded_at) - k * INTERVAL 5 MINUTE AS window_start, count(*) AS jobs_processed, count(*) FILTER (WHERE NOT success) AS jobs_failed, round(avg(duration_ms), 6) AS average_processing_time FROM w GROUP BY 1""", ["v_perf"])
def f7b(t):
    return rounded(A.sliding_rates(t.perf()), "average_processing_time")
