"""Operational events: thresholds, suppression, escalation, limits, breakers, health."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions.common import micros, ratio
from webloom.functions.machines import AdaptiveLimit, Breaker, Notifier, SlidingLimit, TokenBucket
from webloom.operators.ordered import BUCKET, DAY, failure_runs, latest_mark, near_before, trailing, troubled_stretches, with_context

AT = "__at"


def scan_in_order(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], machine, inputs: Sequence[str], outputs: Sequence[tuple[str, T.DataType]],
) -> DataFrame:
    """Runs a machine over the rows of each key in order.

    Rows are streamed from sorted partitions: a key is never held in memory, only its state is.
    """
    kept = df.columns
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, k) for n, k in outputs]])
    key_list, input_list = list(keys), list(inputs)
    names = [n for n, _ in outputs]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            results = []
            marks = list(zip(*[batch[k].tolist() for k in key_list]))
            for mark, row in zip(marks, zip(*[batch[c].tolist() for c in input_list])):
                if mark != current:
                    current, state = mark, machine.start()
                state, result = machine.step(state, *row)
                results.append(result)
            yield pd.concat([batch, pd.DataFrame(results, columns=names, index=batch.index)], axis=1)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).select(*kept).mapInPandas(run, schema)


# --- limits --------------------------------------------------------------------------------

def rate_limit(
    events: DataFrame, client: str, ts: str, tie: str, limit: int, window: float, seconds: int = DAY,
) -> DataFrame:
    """Adds allowed and retry_after (sliding log of allowed events per client).

    While all events of a window, allowed or not, number at most ``limit``, each is allowed: that
    is a count over a time range. Only stretches where a client exceeds its limit, and the window
    before them, go through the sequential rule.
    """
    settled, open_ = troubled_stretches(events, [client], [ts, tie], window, limit, seconds=seconds)
    rows = open_.withColumns({AT: micros(ts), "__known": ~F.col("hot")})
    judged = scan_in_order(rows, [client, "island"], [AT, tie], SlidingLimit(limit, window), [AT, "__known"],
                           [("allowed", T.BooleanType()), ("retry_after", T.LongType())])
    cols = events.columns
    done = settled.select(*cols, F.lit(True).alias("allowed"), F.lit(0).cast("long").alias("retry_after"))
    return done.unionByName(judged.where("hot").select(*cols, "allowed", "retry_after"))


def client_key(user: Column, forwarded: Column, peer: Column) -> Column:
    """user:<id>, else ip:<first forwarded address or peer>."""
    first = F.nullif(F.trim(F.split_part(forwarded, F.lit(","), F.lit(1))), F.lit(""))
    return F.when(user.isNotNull(), F.concat(F.lit("user:"), user.cast("string"))) \
        .otherwise(F.concat(F.lit("ip:"), F.coalesce(first, peer, F.lit("unknown"))))


def limit_for(authenticated: Column, path: Column) -> Column:
    """Requests per minute of the caller's tier."""
    return F.when(~authenticated, 20).when(path.startswith("/api/v1/scraping/jobs"), 100) \
        .when(path.startswith("/api/v1/data"), 200).otherwise(150)


def token_bucket(events: DataFrame, client: str, ts: str, tie: str, capacity: float, rate: float, seconds: int = DAY) -> DataFrame:
    """Adds taken and tokens. A pause long enough to refill the bucket starts a new, independent stretch."""
    timed = near_before(events, [client], [ts, tie], capacity / rate, seconds)
    full = F.col("since_before").isNull() | (F.col("since_before") / 1e6 >= capacity / rate)
    parts = latest_mark(timed, [client], [ts, tie], F.when(full, micros(ts)), "island", seconds).withColumn(AT, micros(ts))
    out = scan_in_order(parts.drop("since_before"), [client, "island"], [AT, tie], TokenBucket(capacity, rate), [AT],
                        [("taken", T.BooleanType()), ("tokens", T.DoubleType())])
    return out.drop("island", AT)


def adaptive_limit(samples: DataFrame, service: str, ts: str, tie: str, base: int, load: str = "load", errors: str = "errors") -> DataFrame:
    """Adds factor and current_limit after each sample of a service."""
    out = scan_in_order(samples.withColumn(AT, micros(ts)), [service], [AT, tie], AdaptiveLimit(base), [AT, load, errors],
                        [("factor", T.DoubleType()), ("current_limit", T.LongType())])
    return out.drop(AT)


# --- breaker -------------------------------------------------------------------------------

def breaker(events: DataFrame, service: str, ts: str, tie: str, success: str, config: Breaker = Breaker(), seconds: int = DAY) -> DataFrame:
    """Adds state_before, state (after the event) and blocked (call not made because the breaker was open).

    When the longest pause has passed since the last failure, ``success_threshold`` successes in a
    row leave the breaker closed whatever came before. Such points cut the events of a service
    into independent islands; a success right after one needs no machine at all.
    """
    order = [ts, tie]
    src = with_context(events, ts, back=config.max_delay, seconds=seconds).withColumn("__bad", (~F.col(success)).cast("int"))
    local = Window.partitionBy(service, BUCKET).orderBy("__at")
    in_order = Window.partitionBy(service, BUCKET).orderBy("__at", tie)
    # running values only: each row costs the same however many lie in the longest pause before it
    so_far, edge = local.rangeBetween(Window.unboundedPreceding, 0), F.col("__at") - int(config.max_delay * 1e6)
    src = src.withColumns({
        "__failed": F.max(F.when(F.col("__bad") == 1, F.col("__at"))).over(so_far),
        "__known": F.max(F.when(F.col("__bad").isNotNull(), F.col("__at"))).over(so_far), "__any": F.max("__bad").over(so_far)})
    no_failure = F.when(F.col("__at").isNull(), F.col("__any") == 0).when(F.col("__failed") >= edge, False).when(F.col("__known") >= edge, True)
    src = src.withColumn("__calm", (no_failure & ~F.col("__context")).cast("int"))
    last_rows = in_order.rowsBetween(-(config.success_threshold - 1), 0)
    quiet = (F.min("__calm").over(last_rows) == 1) & (F.count(F.lit(1)).over(last_rows) == config.success_threshold)
    src = src.withColumn("__quiet", quiet)
    reset = F.coalesce(F.lag("__quiet").over(in_order), F.lit(False))
    src = src.withColumn("__reset", reset).where(~F.col("__context"))
    cols = events.columns
    easy = F.col("__reset") & F.col(success)
    closed = F.lit("closed")
    done = src.where(easy).select(*cols, closed.alias("state_before"), closed.alias("state"), F.lit(False).alias("blocked"))
    rest = src.select(*cols, "__reset", easy.alias("__easy"))
    # the mark is the place of the last reset in order: its time and, among time-mates, its tie-breaker
    place = F.struct(micros(ts).alias("at"), F.col(tie).alias("tie"))
    split = latest_mark(rest, [service], order, F.when(F.col("__reset"), place), "__from", seconds).where(~F.col("__easy"))
    work = split.withColumns({"__i": F.coalesce("__from.at", F.lit(-1)), "__j": F.coalesce("__from.tie", F.lit(-1)), AT: micros(ts)}) \
        .drop("__from", "__reset", "__easy")
    judged = scan_in_order(work, [service, "__i", "__j"], [AT, tie], config, [AT, success], [
        ("state_before", T.StringType()), ("state", T.StringType()), ("blocked", T.BooleanType())])
    return done.unionByName(judged.select(*cols, "state_before", "state", "blocked"))


def breaker_stats(judged: DataFrame, service: str, success: str) -> DataFrame:
    """Per service: calls, successes, failures and blocked calls, success rate, how often each state was entered."""
    made, before, after = ~F.col("blocked"), F.col("state_before"), F.col("state")
    ok = F.count_if(made & F.col(success))
    probing = (before == "open") & made  # a call let through an open breaker makes it half-open first
    return judged.groupBy(service).agg(
        F.count(F.lit(1)).alias("total_requests"), ok.alias("total_successes"),
        F.count_if(made & ~F.col(success)).alias("total_failures"), F.count_if("blocked").alias("blocked"),
        ratio(ok, F.count(F.lit(1))).alias("success_rate"),
        F.count_if((after == "open") & ((before != "open") | probing)).alias("opened"), F.count_if(probing).alias("half_opened"),
        F.count_if((after == "closed") & (before != "closed")).alias("closed_again"))


def backoff(events: DataFrame, service: str, ts: str, tie: str, failed: str, base: float, limit: float, multiplier: float = 2.0, seconds: int = DAY) -> DataFrame:
    """Adds run_length (failures in a row) and delay = base * multiplier^(n-1), at most ``limit``; null after a success."""
    runs = failure_runs(events, [service], [ts, tie], failed, seconds)
    n = F.col("run_length")
    return runs.withColumn("delay", F.when(n > 0, F.least(F.lit(float(limit)), F.lit(float(base)) * F.pow(F.lit(float(multiplier)), n - 1))))


# --- notices -------------------------------------------------------------------------------

def suppress(errors: DataFrame, kind: Sequence[str], ts: str, tie: str, span: float = 60, seconds: int = DAY) -> DataFrame:
    """Adds suppressed: another error of the same kind less than ``span`` seconds before."""
    out = near_before(errors, kind, [ts, tie], span, seconds)
    return out.withColumn("suppressed", F.coalesce(F.col("since_before") < int(span * 1e6), F.lit(False))).drop("since_before")


def escalate(errors: DataFrame, ts: str, urgent: Column, threshold: int = 5, span: float = 600, panes: int = 4, keys: Sequence[str] = ()) -> DataFrame:
    """Urgent errors at which at least ``threshold`` urgent ones lie in the trailing ``span`` seconds,
    with their number, types and components; per ``keys``, else over all errors.

    Time is cut into ``panes`` per span. A pane's rows meet in one task with those that leave the span during it, as
    running differences; what lies between comes as one row per pane. Types and components are looked up only for
    errors that escalate, from the first and last time of each in a pane. So no task holds more than two panes, and an
    error costs the same however many lie in its span.
    """
    whole, keys = int(span * 1_000_000), list(keys)
    panes = panes if whole % panes == 0 else 1
    width = whole // panes
    hot = errors.where(urgent).withColumn("__at", micros(ts)).withColumn("__pane", F.floor(F.col("__at") / width))
    row = F.struct(*errors.columns)
    enters = hot.select(*keys, "__pane", "__at", F.lit(1).alias("__step"), row.alias("__row"))
    leaves = hot.select(*keys, (F.col("__pane") + panes).alias("__pane"), (F.col("__at") + whole).alias("__at"), F.lit(-1).alias("__step"), F.lit(None).cast(enters.schema["__row"].dataType).alias("__row"))
    running = F.sum("__step").over(Window.partitionBy(*keys, "__pane").orderBy("__at").rangeBetween(Window.unboundedPreceding, 0))
    inside = enters.unionByName(leaves).withColumn("__n", running).where("__step = 1").select("__pane", "__at", "__n", "__row")

    def first_and_last(name: str) -> DataFrame:
        each = hot.groupBy(*keys, "__pane", F.col(name).alias("v")).agg(F.min("__at").alias("first"), F.max("__at").alias("last"))
        return each.groupBy(*keys, "__pane").agg(F.collect_list(F.struct("v", "first", "last")).alias(f"__{name}"))

    # each pane tells the next ones what it holds: its errors to all of a span, its names to itself as well
    counts = hot.groupBy(*keys, "__pane").agg(F.count(F.lit(1)).alias("__own"))
    before = counts.withColumn("__pane", F.explode(F.sequence(F.col("__pane") + 1, F.col("__pane") + panes))).groupBy(*keys, "__pane").agg(F.sum("__own").alias("__base"))
    names = first_and_last("error_type").join(first_and_last("component"), [*keys, "__pane"])
    told = names.withColumn("__pane", F.explode(F.sequence(F.col("__pane"), F.col("__pane") + panes)))
    known = told.groupBy(*keys, "__pane").agg(*[F.flatten(F.collect_list(f"__{name}")).alias(f"__{name}") for name in ("error_type", "component")])
    placed = inside.select(*[F.col("__row")[k].alias(k) for k in keys], "__pane", "__at", "__n", "__row").join(before, [*keys, "__pane"], "left")
    counted = placed.withColumn("error_count", F.col("__n") + F.coalesce("__base", F.lit(0))).where(F.col("error_count") >= threshold)

    def present(name: str) -> Column:
        # seen by now, and last seen after the span began; a pane gone by has no other times than these two in question
        held = F.filter(f"__{name}", lambda x: (x["first"] <= F.col("__at")) & (F.least(x["last"], F.col("__at")) > F.col("__at") - whole))
        return F.array_sort(F.array_distinct(F.transform(held, lambda x: x["v"])))

    out = counted.join(known, [*keys, "__pane"])
    return out.select("__row.*", "error_count", present("error_type").alias("error_types"), present("component").alias("components"))


def notify(errors: DataFrame, ts: str, tie: str, kind: str, config: Notifier = Notifier(), scope: Sequence[str] = (), seconds: int = DAY) -> DataFrame:
    """Adds outcome: sent, aggregated or rate_limited.

    ``scope`` names the columns that have a limit of their own; without it one limit holds for all.
    As long as all errors of a window number at most the limit nothing can be held back, and only
    repeats are folded. Crowded stretches go through the sequential rule, each on its own.
    """
    span, scope = config.window, list(scope)
    near = near_before(errors, [*scope, kind], [ts, tie], config.similar, seconds)
    folded = F.coalesce(F.col("since_before") < int(config.similar * 1e6), F.lit(False))
    rows = near.withColumn("__plain", F.when(folded, "aggregated").otherwise("sent")).drop("since_before")
    settled, open_ = troubled_stretches(rows, scope, [ts, tie], span, config.limit, include_edge=False, seconds=seconds)
    known = F.when(~F.col("hot"), F.col("__plain"))
    work = open_.withColumns({AT: micros(ts), "__known": known, "__one": F.lit(1)})
    judged = scan_in_order(work, [*scope, "__one", "island"], [AT, tie], config, [AT, kind, "__known"], [("outcome", T.StringType())])
    cols = errors.columns
    return settled.select(*cols, F.col("__plain").alias("outcome")).unionByName(judged.where("hot").select(*cols, "outcome"))


def outcome_stats(judged: DataFrame, column: str = "outcome") -> DataFrame:
    return judged.groupBy(column).agg(F.count(F.lit(1)).alias("events"))


# --- thresholds and health -----------------------------------------------------------------

def threshold_alerts(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Alert rows for values above the threshold of their metric. The thresholds are configuration, a few rows."""
    limits = F.broadcast(thresholds.select("metric_name", "threshold_value", "severity"))
    return metrics.join(limits, "metric_name").where(F.col("metric_value") > F.col("threshold_value")).withColumns({
        "actual_value": F.col("metric_value"), "status": F.lit("active"),
        "message": F.format_string("%s is %.2f, above %.2f", "metric_name", "metric_value", "threshold_value")})


HEALTH_LIMITS = {"cpu_percent": (80.0, "High CPU usage"), "memory_percent": (85.0, "High memory usage"), "error_rate_percent": (5.0, "High error rate")}


def metric_health(latest: DataFrame) -> DataFrame:
    """Adds status and issues from the latest metrics of a source."""
    known = F.col("cpu_percent").isNotNull() & F.col("memory_percent").isNotNull() & F.col("error_rate_percent").isNotNull()
    issues = F.array_compact(F.array(*[
        F.when(F.col(name) > limit, F.format_string(f"{text}: %.1f%%", name)) for name, (limit, text) in HEALTH_LIMITS.items()]))
    status = F.when(~known, "unknown").when(F.size(issues) > 0, "degraded").otherwise("healthy")
    return latest.withColumns({"status": status, "issues": F.when(known, issues)})


def service_health(workers: Column, error_rate: Column) -> Column:
    return F.when(workers == 0, "DEGRADED").when(error_rate > 50, "UNHEALTHY").when(error_rate > 20, "DEGRADED").otherwise("HEALTHY")


def dependency_health(checks: DataFrame, group: str) -> DataFrame:
    """A group is degraded as soon as one of its services is not up."""
    return checks.groupBy(group).agg(
        F.when(F.count_if(F.col("status") != "up") > 0, "degraded").otherwise("healthy").alias("status"),
        F.count_if(F.col("status") != "up").alias("down"))


# Error classes with severity, whether they can be recovered from, the pause before a
# new attempt where one is set, and the recovery strategy set for the class (else by severity).
ERRORS = (
    ("WebDriverException", "medium", True, None, "retry"),
    ("PageLoadException", "medium", True, None, None),
    ("ElementNotFoundException", "medium", True, None, None),
    ("ContentExtractionException", "medium", True, None, None),
    ("AntiDetectionException", "high", True, 300.0, None),
    ("AIServiceException", "medium", True, None, "fallback"),
    ("ContentProcessingException", "medium", True, None, None),
    ("ConfidenceThresholdException", "low", True, None, None),
    ("DataValidationException", "medium", True, None, None),
    ("DataCleaningException", "medium", True, None, None),
    ("DuplicateDataException", "low", True, None, None),
    ("DatabaseException", "medium", True, None, "retry"),
    ("ConnectionPoolException", "high", True, None, "retry"),
    ("FileStorageException", "medium", True, None, None),
    ("RateLimitException", "medium", True, None, None),
    ("AuthenticationException", "high", False, None, None),
    ("NetworkException", "medium", True, None, "retry"),
    ("JobQueueException", "medium", True, None, None),
    ("JobTimeoutException", "high", True, None, None),
    ("ResourceExhaustionException", "critical", True, None, None),
    ("ConfigurationException", "critical", False, None, None),
    ("ExportException", "medium", True, None, None),
    ("ConnectionError", "medium", True, None, "retry"),
    ("TimeoutError", "medium", True, None, "retry"),
    ("ValueError", "medium", False, None, "fail_fast"),
    ("TypeError", "medium", False, None, "fail_fast"),
)
BY_SEVERITY = {"critical": "fail_fast", "high": "fallback", "medium": "retry", "low": "skip"}
PRIORITIES = {"low": "low", "medium": "normal", "high": "high", "critical": "urgent"}


def error_catalog(spark, extra: Sequence[tuple] = ()) -> DataFrame:
    """Dimension of error classes; ``extra`` rows replace those of the same class."""
    rows = {r[0]: r for r in (*ERRORS, *extra)}
    return spark.createDataFrame(
        [(n, s, r, d, k or BY_SEVERITY[s], PRIORITIES[s]) for n, s, r, d, k in rows.values()],
        "error_type string, severity string, recoverable boolean, retry_after double, strategy string, priority string")


def classify_errors(errors: DataFrame, catalog: DataFrame) -> DataFrame:
    """Joins the catalogue, a table of some dozen rows; unknown classes are medium and retried."""
    out = errors.join(F.broadcast(catalog), "error_type", "left")
    return out.withColumns({
        "severity": F.coalesce("severity", F.lit("medium")), "recoverable": F.coalesce("recoverable", F.lit(True)),
        "strategy": F.coalesce("strategy", F.lit("retry")), "priority": F.coalesce("priority", F.lit("normal"))})


# Result that stands in for a skipped operation, by part of its name.
SAFE_DEFAULTS: Mapping[str, Mapping[str, object]] = {
    "scrape": {"content": "", "success": False},
    "process": {"processed_data": {}, "confidence": 0.0},
    "analyze": {"analysis": {}, "entities": []},
    "export": {"exported": False, "file_path": None},
}


def safe_default(operation: Column, error: Column) -> Column:
    """JSON text of the stand-in result."""
    import json

    def text(values: Mapping) -> Column:
        head = json.dumps(values, separators=(",", ":"))[:-1]
        quoted = F.to_json(F.struct(error.alias("e")))  # {"e":...}
        return F.concat(F.lit(head + ',"error":'), F.substring(quoted, F.lit(6), F.length(quoted) - 6), F.lit("}"))

    out = text({"success": False, "skipped": True})
    for part, values in reversed(SAFE_DEFAULTS.items()):
        out = F.when(F.lower(operation).contains(part), text(values)).otherwise(out)
    return out


def recovery_stats(outcomes: DataFrame) -> DataFrame:
    """Recovered, fallback, degraded and failed counts and the share recovered."""
    kinds = ("recovered", "fallback", "degraded", "failed")
    return outcomes.agg(
        F.count(F.lit(1)).alias("total_errors"), *[F.count_if(F.col("outcome") == k).alias(k) for k in kinds],
        ratio(F.count_if(F.col("outcome") == "recovered"), F.count(F.lit(1))).alias("success_rate"))


