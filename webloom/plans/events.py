"""Event queries: limits, breakers, notices, thresholds, health."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.functions.machines import Breaker, Notifier
from webloom.operators import analytics as A
from webloom.operators import events as E
from webloom.plans.registry import query

SRC = "e AS (SELECT event_id AS id, ts, concat('s', CAST(user_id % {n} AS STRING)) AS src, event_type, value, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id % {n} ORDER BY ts, event_id) AS k FROM events)"


def src(t, n):
    return t["events"].select(
        F.col("event_id").alias("id"), "ts", F.concat(F.lit("s"), (F.col("user_id") % n).cast("string")).alias("src"),
        "event_type", "value", (F.col("event_type") != "error").alias("ok"))


@query("k2_client_tiers", """
SELECT event_id AS id, CASE WHEN event_id % 3 > 0 THEN concat('user:', CAST(user_id AS STRING)) WHEN event_id % 2 = 0 THEN concat('ip:10.0.0.', CAST(user_id AS STRING)) ELSE 'ip:127.0.0.1' END AS client,
 CASE WHEN event_id % 3 = 0 THEN 20 WHEN event_type = 'view' THEN 100 WHEN event_type = 'error' THEN 200 ELSE 150 END AS allowed_per_minute FROM events""")
def k2_tiers(t):
    e, known = t["events"], F.col("event_id") % 3 > 0
    forwarded = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" 10.0.0."), F.col("user_id").cast("string"), F.lit(", 172.16.0.1")))
    path = F.when(F.col("event_type") == "view", "/api/v1/scraping/jobs/7").when(F.col("event_type") == "error", "/api/v1/data").otherwise("/api/v1/health")
    return e.select(F.col("event_id").alias("id"), E.client_key(F.when(known, F.col("user_id")), forwarded, F.lit("127.0.0.1")).alias("client"),
                    E.limit_for(known, path).alias("allowed_per_minute"))


@query("k2_sliding_limit", f"""
WITH RECURSIVE {SRC.format(n=30)},
r AS (SELECT src, k, id, [epoch_us(ts)] AS h, true AS allowed, CAST(0 AS BIGINT) AS retry_after FROM e WHERE k = 1
 UNION ALL SELECT e.src, e.k, e.id,
  CASE WHEN len(list_filter(r.h, lambda x: x >= epoch_us(e.ts) - 43200000000)) < 3 THEN list_append(list_filter(r.h, lambda x: x >= epoch_us(e.ts) - 43200000000), epoch_us(e.ts)) ELSE list_filter(r.h, lambda x: x >= epoch_us(e.ts) - 43200000000) END,
  len(list_filter(r.h, lambda x: x >= epoch_us(e.ts) - 43200000000)) < 3,
  CASE WHEN len(list_filter(r.h, lambda x: x >= epoch_us(e.ts) - 43200000000)) < 3 THEN 0 ELSE greatest(CAST(floor((list_min(list_filter(r.h, lambda x: x >= epoch_us(e.ts) - 43200000000)) + 43200000000 - epoch_us(e.ts)) / 1e6) AS BIGINT) + 1, 1) END
 FROM r JOIN e ON e.src = r.src AND e.k = r.k + 1)
SELECT id, src, allowed, retry_after FROM r""")
def k2(t):
    return E.rate_limit(src(t, 30), "src", "ts", "id", limit=3, window=43200).select("id", "src", "allowed", "retry_after")


@query("k3_token_bucket", f"""
WITH RECURSIVE {SRC.format(n=30)},
r AS (SELECT src, k, id, ts, 2.0::DOUBLE AS tokens, true AS taken FROM e WHERE k = 1
 UNION ALL SELECT src, k, id, ts, CASE WHEN f >= 1 THEN f - 1 ELSE f END, f >= 1 FROM (
  SELECT e.src, e.k, e.id, e.ts, least(3.0::DOUBLE, r.tokens + (epoch_us(e.ts) - epoch_us(r.ts)) / 1e6 * 0.0001::DOUBLE) AS f FROM r JOIN e ON e.src = r.src AND e.k = r.k + 1))
SELECT id, taken, round(tokens, 5) AS tokens FROM r""")
def k3(t):
    return E.token_bucket(src(t, 30), "src", "ts", "id", 3.0, 0.0001).select("id", "taken", F.round("tokens", 5).alias("tokens"))


@query("k4_adaptive_limit", f"""
WITH RECURSIVE {SRC.format(n=30)}, s AS (SELECT src, k, id, ts, value / 60 AS load, value / 200 AS errors FROM e),
r AS (SELECT src, k, id, ts AS last, 1.0::DOUBLE AS factor FROM s WHERE k = 1
 UNION ALL SELECT s.src, s.k, s.id, CASE WHEN epoch_us(s.ts) - epoch_us(r.last) < 30000000 THEN r.last ELSE s.ts END,
  CASE WHEN epoch_us(s.ts) - epoch_us(r.last) < 30000000 THEN r.factor WHEN s.load > 0.8 OR s.errors > 0.1 THEN greatest(0.5, r.factor * 0.9) WHEN s.load < 0.5 AND s.errors < 0.05 THEN least(2.0, r.factor * 1.1) ELSE r.factor END
 FROM r JOIN s ON s.src = r.src AND s.k = r.k + 1)
SELECT id, round(factor, 6) AS factor, CAST(floor(100 * factor) AS BIGINT) AS current_limit FROM r""")
def k4(t):
    s = src(t, 30).withColumns({"load": F.col("value") / 60, "errors": F.col("value") / 200})
    return E.adaptive_limit(s, "src", "ts", "id", 100).select("id", F.round("factor", 6).alias("factor"), "current_limit")


FAULTY = SRC.format(n=20).replace("event_type <> 'error' AS ok", "NOT (event_type IN ('error', 'view') OR (event_type = 'click' AND value > 5)) AS ok")


def faulty(t):
    bad = F.col("event_type").isin("error", "view") | ((F.col("event_type") == "click") & (F.col("value") > 5))
    return src(t, 20).withColumn("ok", ~bad)


BREAKER_SQL = f"""
WITH RECURSIVE {FAULTY}, r AS (
 SELECT src, k, id, 'closed' AS state, CASE WHEN ok THEN 0 ELSE 1 END AS f, 0 AS s, CAST(0 AS BIGINT) AS nxt, false AS blocked FROM e WHERE k = 1
 UNION ALL SELECT src, k, id,
  CASE WHEN blocked THEN 'open' WHEN ok AND st = 'half_open' AND s0 + 1 >= 2 THEN 'closed' WHEN ok THEN st WHEN st = 'half_open' OR f0 + 1 >= 3 THEN 'open' ELSE st END,
  CASE WHEN blocked THEN f0 WHEN ok AND st = 'half_open' AND s0 + 1 >= 2 THEN 0 WHEN ok AND st = 'closed' THEN 0 WHEN ok THEN f0 ELSE f0 + 1 END,
  CASE WHEN blocked THEN s0 WHEN ok AND st = 'half_open' THEN CASE WHEN s0 + 1 >= 2 THEN 0 ELSE s0 + 1 END ELSE s0 END,
  CASE WHEN NOT blocked AND NOT ok AND (st = 'half_open' OR f0 + 1 >= 3) THEN tt + CAST(least(600.0 * power(2, f0), 14400) * 1000000 AS BIGINT) ELSE nxt END, blocked
 FROM (SELECT e.src, e.k, e.id, e.ok, epoch_us(e.ts) AS tt, r.nxt, r.f AS f0, CASE WHEN r.state = 'open' AND epoch_us(e.ts) >= r.nxt THEN 0 ELSE r.s END AS s0,
   r.state = 'open' AND epoch_us(e.ts) < r.nxt AS blocked, CASE WHEN r.state = 'open' AND epoch_us(e.ts) >= r.nxt THEN 'half_open' ELSE r.state END AS st
  FROM r JOIN e ON e.src = r.src AND e.k = r.k + 1))
"""
CONFIG = Breaker(failure_threshold=3, success_threshold=2, initial_delay=600.0, max_delay=14400.0)


@query("k5_circuit_breaker", BREAKER_SQL + "SELECT id, src, state, blocked FROM r")
def k5(t):
    return E.breaker(faulty(t), "src", "ts", "id", "ok", CONFIG).select("id", "src", "state", "blocked")


@query("f27_breaker_stats", BREAKER_SQL + """, j AS (SELECT r.*, e.ok, coalesce(lag(r.state) OVER (PARTITION BY r.src ORDER BY r.k), 'closed') AS prev FROM r JOIN e ON e.id = r.id)
SELECT src, count(*) AS total_requests, count(*) FILTER (WHERE NOT blocked AND ok) AS total_successes, count(*) FILTER (WHERE NOT blocked AND NOT ok) AS total_failures, count(*) FILTER (WHERE blocked) AS blocked,
 round(count(*) FILTER (WHERE NOT blocked AND ok)::DOUBLE / count(*), 6) AS success_rate,
 count(*) FILTER (WHERE state = 'open' AND (prev <> 'open' OR NOT blocked)) AS opened, count(*) FILTER (WHERE prev = 'open' AND NOT blocked) AS half_opened, count(*) FILTER (WHERE state = 'closed' AND prev <> 'closed') AS closed_again FROM j GROUP BY src""")
def f27(t):
    judged = E.breaker(faulty(t), "src", "ts", "id", "ok", CONFIG)
    return E.breaker_stats(judged, "src", "ok").withColumn("success_rate", F.round("success_rate", 6))


@query("g11_backoff_schedule", f"""
WITH {FAULTY}, i AS (SELECT *, sum(ok::INT) OVER (PARTITION BY src ORDER BY ts, id) AS run FROM e),
n AS (SELECT *, CASE WHEN ok THEN 0 ELSE row_number() OVER (PARTITION BY src, run ORDER BY ts, id) - CASE WHEN first_value(ok) OVER (PARTITION BY src, run ORDER BY ts, id) THEN 1 ELSE 0 END END AS n FROM i)
SELECT id, CAST(n AS BIGINT) AS run_length, CASE WHEN n > 0 THEN least(30.0, power(2, n - 1))::DOUBLE END AS delay FROM n""")
def g11(t):
    e = faulty(t).withColumn("bad", ~F.col("ok"))
    return E.backoff(e, "src", "ts", "id", "bad", 1.0, 30.0).select("id", "run_length", "delay")


ERR = "x AS (SELECT event_id AS id, ts, concat('E', CAST(event_id % 4 AS STRING)) AS error_type, concat('c', CAST(user_id % 3 AS STRING)) AS component, value FROM events WHERE event_type = 'error')"


def errs(t):
    return t["events"].where("event_type = 'error'").select(
        F.col("event_id").alias("id"), "ts", F.concat(F.lit("E"), (F.col("event_id") % 4).cast("string")).alias("error_type"),
        F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("component"), "value")


@query("g9_similar_suppression", f"""
WITH {ERR} SELECT id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY error_type, component ORDER BY ts, id)) < 7200000000, false) AS suppressed FROM x""")
def g9(t):
    return E.suppress(errs(t), ["error_type", "component"], "ts", "id", 7200).select("id", "suppressed")


@query("g10_escalation", f"""
WITH {ERR}, h AS (SELECT * FROM x WHERE value > 5)
SELECT a.id, count(*) AS error_count, string_agg(DISTINCT b.error_type, ',' ORDER BY b.error_type) AS error_types, string_agg(DISTINCT b.component, ',' ORDER BY b.component) AS components
FROM h a JOIN h b ON epoch_us(b.ts) > epoch_us(a.ts) - 7200000000 AND epoch_us(b.ts) <= epoch_us(a.ts) GROUP BY a.id HAVING count(*) >= 5""")
def g10(t):
    out = E.escalate(errs(t), "ts", F.col("value") > 5, 5, 7200)
    return out.select("id", "error_count", F.array_join("error_types", ",").alias("error_types"), F.array_join("components", ",").alias("components"))


@query("k6_notification_flow", f"""
WITH RECURSIVE {ERR}, y AS (SELECT id, ts, component, error_type AS kind, row_number() OVER (PARTITION BY component ORDER BY ts, id) AS k FROM x),
r AS (SELECT component, k, id, [epoch_us(ts)] AS sent, [{{'kind': kind, 'tt': epoch_us(ts)}}] AS seen, 'sent' AS outcome FROM y WHERE k = 1
 UNION ALL SELECT component, k, id, CASE WHEN lim OR rep THEN s ELSE list_append(s, tt) END,
  CASE WHEN lim THEN m ELSE list_append(m, {{'kind': kind, 'tt': tt}}) END, CASE WHEN lim THEN 'rate_limited' WHEN rep THEN 'aggregated' ELSE 'sent' END
 FROM (SELECT *, len(s) >= 4 AS lim, len(list_filter(m, lambda q: q.kind = kind)) > 0 AS rep FROM (
  SELECT y.component, y.k, y.id, y.kind, epoch_us(y.ts) AS tt, list_filter(r.sent, lambda q: q > epoch_us(y.ts) - 28800000000) AS s, list_filter(r.seen, lambda q: q.tt > epoch_us(y.ts) - 3600000000) AS m
  FROM r JOIN y ON y.component = r.component AND y.k = r.k + 1)))
SELECT id, component, outcome FROM r""")
def k6(t):
    return E.notify(errs(t), "ts", "id", "error_type", Notifier(4, 28800.0, 3600.0), ["component"]).select("id", "component", "outcome")


@query("k6_single_limit", f"""
WITH RECURSIVE {ERR}, y AS (SELECT ts, error_type AS kind, row_number() OVER (ORDER BY ts, id) AS k FROM x),
r AS (SELECT k, [epoch_us(ts)] AS sent, [{{'kind': kind, 'tt': epoch_us(ts)}}] AS seen, 'sent' AS outcome FROM y WHERE k = 1
 UNION ALL SELECT k, CASE WHEN lim OR rep THEN s ELSE list_append(s, tt) END,
  CASE WHEN lim THEN m ELSE list_append(m, {{'kind': kind, 'tt': tt}}) END, CASE WHEN lim THEN 'rate_limited' WHEN rep THEN 'aggregated' ELSE 'sent' END
 FROM (SELECT *, len(s) >= 10 AS lim, len(list_filter(m, lambda q: q.kind = kind)) > 0 AS rep FROM (
  SELECT y.k, y.kind, epoch_us(y.ts) AS tt, list_filter(r.sent, lambda q: q > epoch_us(y.ts) - 14400000000) AS s, list_filter(r.seen, lambda q: q.tt > epoch_us(y.ts) - 3600000000) AS m
  FROM r JOIN y ON y.k = r.k + 1)))
SELECT outcome, count(*) AS events FROM r GROUP BY outcome""")
def k6b(t):
    """One limit for all components."""
    judged = E.notify(errs(t), "ts", "id", "error_type", Notifier(10, 14400.0, 3600.0))
    return E.outcome_stats(judged)


def _metrics(t):
    p = t.perf()
    return p.select("metric_id", F.col("operation_name").alias("metric_name"), F.col("duration_ms").alias("metric_value"), "recorded_at")


def thresholds(t):
    return t.spark.createDataFrame([("op_0", 50.0, "high"), ("op_1", 10.0, "medium"), ("op_4", 100.0, "critical")], "metric_name string, threshold_value double, severity string")


@query("e9_threshold_alerts", """
SELECT metric_id, operation_name AS metric_name, duration_ms AS actual_value, threshold_value, severity FROM v_perf
JOIN (VALUES ('op_0', 50.0::DOUBLE, 'high'), ('op_1', 10.0, 'medium'), ('op_4', 100.0, 'critical')) h(metric_name, threshold_value, severity) ON h.metric_name = operation_name WHERE duration_ms > threshold_value""", ["v_perf"])
def e9(t):
    return E.threshold_alerts(_metrics(t), thresholds(t)).select("metric_id", "metric_name", "actual_value", "threshold_value", "severity")


@query("f26_metric_health", """
WITH l AS (SELECT user_id, arg_max(value, (ts, event_id)) AS cpu, arg_max(event_id % 100, (ts, event_id)) AS mem, arg_max(value / 10, (ts, event_id)) AS err FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN cpu > 80 OR mem > 85 OR err > 5 THEN 'degraded' ELSE 'healthy' END AS status, concat_ws('; ', CASE WHEN cpu > 80 THEN printf('High CPU usage: %.1f%%', cpu) END, CASE WHEN mem > 85 THEN printf('High memory usage: %.1f%%', mem::DOUBLE) END,
 CASE WHEN err > 5 THEN printf('High error rate: %.1f%%', err) END) AS issues FROM l""".replace("printf('High CPU usage: %.1f%%', cpu)", "concat('High CPU usage: ', CAST(round(cpu, 1) AS STRING), '%')")
    .replace("printf('High memory usage: %.1f%%', mem::DOUBLE)", "concat('High memory usage: ', CAST(mem::DOUBLE AS STRING), '%')").replace("printf('High error rate: %.1f%%', err)", "concat('High error rate: ', CAST(round(err, 1) AS STRING), '%')"))
def f26(t):
    e = t["events"].select("user_id", "event_id", "ts", F.col("value").alias("cpu_percent"), (F.col("event_id") % 100).cast("double").alias("memory_percent"), (F.col("value") / 10).alias("error_rate_percent"))
    out = E.metric_health(A.latest(e, "user_id", "ts", "event_id"))
    return out.select("user_id", "status", F.array_join("issues", "; ").alias("issues"))


@query("f26_service_health", """
WITH s AS (SELECT operation_name, count(DISTINCT client_id) FILTER (WHERE duration_ms > 100) AS workers, count(*) FILTER (WHERE NOT success)::DOUBLE / count(*) * 100 AS er FROM v_perf GROUP BY 1)
SELECT operation_name, CASE WHEN workers = 0 THEN 'DEGRADED' WHEN er > 50 THEN 'UNHEALTHY' WHEN er > 20 THEN 'DEGRADED' ELSE 'HEALTHY' END AS health FROM s""", ["v_perf"])
def f26b(t):
    s = t.perf().groupBy("operation_name").agg(
        F.countDistinct(F.when(F.col("duration_ms") > 100, F.col("client_id"))).alias("workers"), (F.avg((~F.col("success")).cast("double")) * 100).alias("er"))
    return s.select("operation_name", E.service_health(F.col("workers"), F.col("er")).alias("health"))


@query("f26_dependency_health", """
SELECT user_id % 10 AS grp, CASE WHEN count(*) FILTER (WHERE value > 200) > 0 THEN 'degraded' ELSE 'healthy' END AS status, count(*) FILTER (WHERE value > 200) AS down FROM events GROUP BY 1""")
def f26c(t):
    checks = t["events"].select((F.col("user_id") % 10).alias("grp"), F.when(F.col("value") > 200, "down").otherwise("up").alias("status"))
    return E.dependency_health(checks, "grp")


@query("f27_notification_stats", f"""
WITH {ERR} SELECT CASE WHEN s THEN 'aggregated' ELSE 'sent' END AS outcome, count(*) AS events FROM (SELECT coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY error_type, component ORDER BY ts, id)) < 7200000000, false) AS s FROM x) GROUP BY 1""")
def f27b(t):
    marked = E.suppress(errs(t), ["error_type", "component"], "ts", "id", 7200)
    return E.outcome_stats(marked.withColumn("outcome", F.when(F.col("suppressed"), "aggregated").otherwise("sent")))


@query("f27_recovery_stats", """
SELECT count(*) AS total_errors, count(*) FILTER (WHERE event_id % 4 = 0) AS recovered, count(*) FILTER (WHERE event_id % 4 = 1) AS fallback, count(*) FILTER (WHERE event_id % 4 = 2) AS degraded, count(*) FILTER (WHERE event_id % 4 = 3) AS failed,
 round(count(*) FILTER (WHERE event_id % 4 = 0)::DOUBLE / count(*), 6) AS success_rate FROM events WHERE event_type = 'error'""")
def f27c(t):
    k = F.col("id") % 4
    o = errs(t).select(F.when(k == 0, "recovered").when(k == 1, "fallback").when(k == 2, "degraded").otherwise("failed").alias("outcome"))
    return E.recovery_stats(o).withColumn("success_rate", F.round("success_rate", 6))


CATALOG_SQL = ", ".join(
    f"('{n}', '{s}', {str(r).lower()}, {'NULL' if d is None else d}::DOUBLE, '{k or E.BY_SEVERITY[s]}', '{E.PRIORITIES[s]}')" for n, s, r, d, k in E.ERRORS)


@query("j28_error_classification", f"""
WITH c(error_type, severity, recoverable, retry_after, strategy, priority) AS (VALUES {CATALOG_SQL}),
e AS (SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'NetworkException' WHEN 1 THEN 'AntiDetectionException' WHEN 2 THEN 'ConfigurationException' WHEN 3 THEN 'DuplicateDataException' ELSE 'KeyError' END AS error_type FROM events WHERE event_type = 'error')
SELECT id, e.error_type, coalesce(severity, 'medium') AS severity, coalesce(recoverable, true) AS recoverable, retry_after, coalesce(strategy, 'retry') AS strategy, coalesce(priority, 'normal') AS priority FROM e LEFT JOIN c USING (error_type)""")
def j28(t):
    k = F.col("id") % 5
    name = F.when(k == 0, "NetworkException").when(k == 1, "AntiDetectionException").when(k == 2, "ConfigurationException").when(k == 3, "DuplicateDataException").otherwise("KeyError")
    e = errs(t).select("id", name.alias("error_type"))
    return E.classify_errors(e, E.error_catalog(t.spark)).select("id", "error_type", "severity", "recoverable", "retry_after", "strategy", "priority")


@query("m3_registered_strategy", "SELECT CASE WHEN event_id % 4 = 0 THEN 'skip' ELSE 'retry' END AS strategy, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1")
def m3(t):
    catalog = E.error_catalog(t.spark, [("NetworkException", "low", True, 5.0, "skip")])
    e = errs(t).withColumn("error_type", F.when(F.col("error_type") == "E0", "NetworkException").otherwise(F.col("error_type")))
    return E.classify_errors(e, catalog).groupBy("strategy").agg(F.count(F.lit(1)).alias("errors"))


@query("j30_safe_defaults", """
SELECT event_id AS id, CASE event_type WHEN 'view' THEN '{"content":"","success":false,"error":"x\\"y"}' WHEN 'click' THEN '{"exported":false,"file_path":null,"error":"x\\"y"}' ELSE '{"success":false,"skipped":true,"error":"x\\"y"}' END AS stand_in FROM events""")
def j30(t):
    op = F.when(F.col("event_type") == "view", "Scrape_page").when(F.col("event_type") == "click", "run_export").otherwise("other")
    return t["events"].select(F.col("event_id").alias("id"), E.safe_default(op, F.lit('x"y')).alias("stand_in"))
