"""Counts, rates, distributions and trends over jobs, records and performance events.

Everything here is a partial-then-final aggregation: what crosses the network is one row per group
and task, whatever the size of the input.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.common import before, micros, moment, ratio, seconds_between
from webloom.functions.urls import host
from webloom.operators.records import ACTIVE, recent

#: Size of a distinct-count sketch as a power of two, and its relative standard error.
SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)
STATUSES = ("pending", "running", "completed", "failed", "cancelled")
N = F.lit


def _rows() -> Column:
    return F.count(F.lit(1))


def _mean(column: str | Column) -> Column:
    return F.coalesce(F.avg(column), F.lit(0.0))


# --- jobs ----------------------------------------------------------------------------------

def job_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(_rows().alias("jobs"))


def status_counts_filled(jobs: DataFrame) -> DataFrame:
    """Counts per status with every known status present."""
    known = jobs.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return known.join(job_counts(jobs), "status", "left").select("status", F.coalesce("jobs", F.lit(0)).alias("jobs"))


def job_performance(jobs: DataFrame) -> DataFrame:
    done = jobs.where("status = 'completed'")
    return done.agg(
        _mean("total_pages").alias("avg_pages"),
        F.coalesce(F.sum("total_pages"), F.lit(0)).alias("total_pages"),
        _mean(seconds_between("started_at", "completed_at")).alias("avg_duration_seconds"),
    )


def job_stats(jobs: DataFrame, records: DataFrame) -> DataFrame:
    """Totals by status, mean time to finish, success rate and pages per minute of completed jobs, mean quality of
    the records (null without any)."""
    done = F.col("status") == "completed"
    seconds = seconds_between("started_at", "completed_at")
    by_status = [F.count_if(F.col("status") == s).alias(f"{s}_jobs") for s in STATUSES]
    ended = F.count_if(F.col("status").isin("completed", "failed"))
    return jobs.agg(
        _rows().alias("total_jobs"), *by_status,
        F.coalesce(F.avg(F.when(done, seconds)), F.lit(0.0)).alias("avg_completion_seconds"),
        ratio(F.count_if(done), ended, 100).alias("success_rate"),
        F.coalesce(
            F.try_divide(F.sum(F.when(done & seconds.isNotNull(), F.col("pages_completed"))).cast("double"),
                         F.sum(F.when(done, seconds)) / 60), F.lit(0.0)).alias("pages_per_minute"),
    ).select("*", records.agg(F.avg("data_quality_score")).scalar().alias("avg_quality"))


def common_errors(jobs: DataFrame, k: int) -> DataFrame:
    return top_k(jobs.where(F.col("error_message").isNotNull()), "error_message", k)


def job_history(jobs: DataFrame) -> DataFrame:
    """Key figures of the job list, case of the status as stored (lower)."""
    return jobs.agg(
        _rows().alias("total_jobs"),
        F.count_if(F.col("status") == "running").alias("running_jobs"),
        ratio(F.count_if(F.col("status") == "completed"), _rows(), 100).alias("success_rate"),
        F.coalesce(F.sum("pages_completed"), F.lit(0)).alias("pages"),
        _mean("pages_completed").alias("avg_pages"),
    )


def active_summary(jobs: DataFrame) -> DataFrame:
    """Active jobs in all, by status and by priority, from one scan: (dimension, value, jobs)."""
    active = jobs.where(F.col("status").isin(*ACTIVE))
    sets = active.groupingSets(
        [[], [F.col("status")], [F.col("priority")]], F.col("status"), F.col("priority")
    ).agg(_rows().alias("jobs"), F.grouping_id().alias("g"))
    return sets.select(
        F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "status").otherwise("priority").alias("dimension"),
        F.when(F.col("g") == 3, "active").otherwise(F.coalesce("status", F.col("priority").cast("string"))).alias("value"),
        "jobs",
    )


def run_result(results: DataFrame, pages_failed: DataFrame | None = None) -> DataFrame:
    """Per job: pages read, pages failed, mean confidence, success rate; success iff anything was read."""
    ok = results.groupBy("job_id").agg(_rows().alias("pages_scraped"), F.avg("confidence_score").alias("average_confidence"))
    if pages_failed is None:
        pages_failed = results.sparkSession.createDataFrame([], "job_id bigint, pages_failed bigint")
    out = pages_failed.select("job_id", "pages_failed").join(ok, "job_id", "full")
    read, lost = F.coalesce("pages_scraped", F.lit(0)), F.coalesce("pages_failed", F.lit(0)).cast("long")
    return out.select(
        "job_id", read.alias("pages_scraped"), lost.alias("pages_failed"),
        F.coalesce("average_confidence", F.lit(0.0)).alias("average_confidence"),
        ratio(read, read + lost).alias("success_rate"), (read > 0).alias("success"),
    )


def job_detail(jobs: DataFrame, logs: DataFrame, records: DataFrame, loads: DataFrame) -> DataFrame:
    """Job header with the number and latest of its logs, the figures of its records and the mean of its page loads.

    ``loads``: (job_id, load_seconds), one row per page load; a job without any has a null mean.

    The log lines themselves stay a table (``job_log_lines``): a job may have any number of them.
    """
    per_log = logs.groupBy("job_id").agg(_rows().alias("log_lines"), F.max("log_id").alias("latest_log"))
    per_record = records.groupBy("job_id").agg(
        _rows().alias("records"), F.avg("data_quality_score").alias("quality"),
        F.avg((F.size("validation_errors") == 0).cast("double")).alias("success_rate"),
    )
    per_load = loads.groupBy("job_id").agg(F.avg("load_seconds").alias("average_load_seconds"))
    header = jobs.select("job_id", "status")
    return header.join(per_log, "job_id", "left").join(per_record, "job_id", "left").join(per_load, "job_id", "left").select(
        "job_id", "status", F.coalesce("log_lines", F.lit(0)).alias("log_lines"), "latest_log",
        F.coalesce("records", F.lit(0)).alias("records"),
        F.coalesce("quality", F.lit(0.0)).alias("quality"), F.coalesce("success_rate", F.lit(0.0)).alias("success_rate"),
        "average_load_seconds",
    )


def job_log_lines(logs: DataFrame, job_id: object) -> DataFrame:
    return logs.where(F.col("job_id") == F.lit(job_id)).orderBy(F.desc("log_id"))


# --- records -------------------------------------------------------------------------------

def quality_metrics(records: DataFrame) -> DataFrame:
    errors = F.size("validation_errors")
    return records.agg(
        _mean("confidence_score").alias("avg_confidence"),
        _mean("data_quality_score").alias("avg_quality"),
        _rows().alias("total_records"),
        ratio(F.count_if("ai_processed"), _rows(), 100).alias("ai_processed_percent"),
        F.coalesce(F.avg(F.when(errors > 0, errors)), F.lit(0.0)).alias("avg_validation_errors"),
    )


def data_summary(records: DataFrame, high: float = 0.8) -> DataFrame:
    """Totals, mean confidence, time range, counts of confident, analysed and faulty records, and ``content_types``, an
    array of (content_type, records), largest first, ties by name. A null type is counted as "unknown"."""
    kind = F.coalesce("content_type", F.lit("unknown")).alias("content_type")
    kinds = records.groupBy(kind).agg(_rows().alias("records")).agg(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("records")).alias("o"), "content_type", "records"))),
        lambda x: F.struct(x["content_type"].alias("content_type"), x["records"].alias("records"))))
    # The exact count of jobs is the one figure that needs the rows regrouped by job.
    return records.agg(
        _rows().alias("total_records"), F.countDistinct("job_id").alias("total_jobs"),
        _mean("confidence_score").alias("avg_confidence"),
        F.min("extracted_at").alias("first_extracted"), F.max("extracted_at").alias("last_extracted"),
        F.count_if(F.col("confidence_score") >= high).alias("high_confidence"),
        F.count_if("ai_processed").alias("ai_processed"),
        F.count_if(F.size("validation_errors") > 0).alias("with_errors"),
    ).select("*", kinds.scalar().alias("content_types"))


def by_content_type(records: DataFrame) -> DataFrame:
    return records.groupBy("content_type").agg(_rows().alias("records"), F.avg("data_quality_score").alias("avg_quality"))


def top_k(df: DataFrame, column: str, k: int, count: str = "rows") -> DataFrame:
    counted = df.groupBy(column).agg(_rows().alias(count))
    return counted.orderBy(F.desc(count), column).limit(k)


def top_domains(records: DataFrame, k: int) -> DataFrame:
    """Records per host, the k largest by name and the rest as "other"."""
    counted = records.groupBy(host("url").alias("domain")).agg(_rows().alias("records"))
    leaders = counted.orderBy(F.desc("records"), "domain").limit(k).select(F.col("domain").alias("leader"))
    # k names at most: small by construction
    named = counted.join(F.broadcast(leaders), F.col("domain") == F.col("leader"), "left")
    return named.groupBy(F.coalesce("leader", F.lit("other")).alias("domain")).agg(F.sum("records").alias("records"))


def score_histogram(records: DataFrame, score: str) -> DataFrame:
    """Counts per 0.1-wide bin '0.0' to '0.9'; a score of 1 is in the last bin."""
    bin_no = F.least(F.floor(F.round(F.col(score) * 10, 9)), F.lit(9))
    return records.groupBy(F.concat(F.lit("0."), bin_no.cast("string")).alias("bin")).agg(_rows().alias("records"))


def volume(records: DataFrame, grain: str, failed: Column, ts: str = "extracted_at", start: object = None, end: object = None) -> DataFrame:
    """Rows per day or hour with those that failed; empty periods inside the range are filled with 0."""
    grouped = records.groupBy(F.date_trunc(grain, ts).cast(records.schema[ts].dataType).alias("period")).agg(
        _rows().alias("count"), F.count_if(failed).alias("error_count"))
    if start is None:
        return grouped.select("period", "count", (F.col("count") - F.col("error_count")).alias("success_count"), "error_count")
    steps = records.sparkSession.range(1).select(
        F.explode(F.sequence(moment(records, ts, start), moment(records, ts, end), F.expr(f"INTERVAL 1 {grain}"))).alias("period"))
    count, errors = F.coalesce("count", F.lit(0)), F.coalesce("error_count", F.lit(0))
    return steps.join(grouped, "period", "left").select(
        "period", count.alias("count"), (count - errors).alias("success_count"), errors.alias("error_count"))


def quality_trend(records: DataFrame) -> DataFrame:
    return records.groupBy(F.to_date("extracted_at").alias("day")).agg(
        F.avg("data_quality_score").alias("avg_quality"), F.avg("confidence_score").alias("avg_confidence"),
        F.avg(F.col("ai_processed").cast("double")).alias("ai_share"), _rows().alias("records"))


def deltas(df: DataFrame, period: str, metrics: Sequence[str]) -> DataFrame:
    """Each metric minus that of the period before; the input is one row per period."""
    order = Window.orderBy(period)
    return df.select(period, *metrics, *[
        (F.col(m) - F.lag(m).over(order)).alias(f"{m}_delta") for m in metrics])


def error_counts(records: DataFrame) -> DataFrame:
    return records.select(F.explode("validation_errors").alias("error_type")).groupBy("error_type").agg(_rows().alias("errors"))


def error_share(records: DataFrame) -> DataFrame:
    found = F.size("validation_errors")
    return records.agg(
        F.coalesce(F.sum(found), F.lit(0)).alias("errors"),
        F.count_if(found > 0).alias("records_with_errors"),
        ratio(F.count_if(found > 0), _rows(), 100).alias("error_rate"),
    )


def sources(records: DataFrame) -> DataFrame:
    return records.agg(
        _rows().alias("records"), F.countDistinct(host("url")).alias("sources"),
        _mean("data_quality_score").alias("avg_quality"), _mean("confidence_score").alias("avg_confidence"))


def source_sketches(df: DataFrame, ts: str, value: Column, groups: Sequence[str] = ()) -> DataFrame:
    """Per day (and group): rows and a sketch of the distinct values, to be stored. A day is sketched once; any span
    of days is answered by ``merged_distinct`` without the rows. Null values are not counted."""
    return df.groupBy(F.to_date(ts).alias("day"), *groups).agg(_rows().alias("rows"), F.hll_sketch_agg(value, F.lit(SKETCH_BITS)).alias("sketch"))


def merged_distinct(sketches: DataFrame, *groups: Column | str) -> DataFrame:
    """Rows and estimated distinct values of stored day sketches, merged by ``groups`` (none: over all).

    Relative error 1.04 / 2 ** (SKETCH_BITS / 2), that is 1.6 %, one standard deviation; small counts are exact.
    """
    merged = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return sketches.groupBy(*groups).agg(F.sum("rows").alias("rows"), merged.alias("distinct_values"))


def facets(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Distinct values of each filter field: (facet, value)."""
    pairs = F.array(*[F.struct(F.lit(n).alias("facet"), c.cast("string").alias("value")) for n, c in columns.items()])
    return df.select(F.explode(pairs).alias("p")).select("p.facet", "p.value").distinct()


# Kinds of issue, their severity and the description shown with them.
ISSUES = (
    ("missing_content", "medium", "Records with empty content fields"),
    ("low_confidence", "low", "Records with confidence score below 0.5"),
)


def validate_run(records: DataFrame) -> DataFrame:
    """Records checked, passed and failed, the share that passed, and the count of each issue."""
    missing = (F.coalesce(F.trim("title"), F.lit("")) == "") | (F.coalesce(F.trim("text"), F.lit("")) == "")
    low = F.coalesce("confidence_score", F.lit(0.0)) < 0.5
    return records.agg(
        _rows().alias("total_records_checked"),
        F.count_if(~(missing | low)).alias("validation_passed"),
        F.count_if(missing | low).alias("validation_failed"),
        ratio(F.count_if(~(missing | low)), _rows()).alias("quality_score"),
        F.count_if(missing).alias("missing_content"),
        F.count_if(low).alias("low_confidence"),
    )


def run_issues(validated: DataFrame) -> DataFrame:
    """The issues of a validation run, one row each, those that did not occur left out."""
    rows = F.array(*[
        F.struct(F.lit(kind).alias("type"), F.col(kind).alias("count"), F.lit(severity).alias("severity"),
                 F.lit(text).alias("description")) for kind, severity, text in ISSUES])
    return validated.select(F.explode(rows).alias("i")).select("i.*").where("count > 0")


# --- performance events --------------------------------------------------------------------

def hourly_history(perf: DataFrame, as_of: object, hours: int = 24) -> DataFrame:
    kept = recent(perf, "recorded_at", as_of, hours=hours)
    hour = F.date_trunc("hour", "recorded_at").cast(perf.schema["recorded_at"].dataType)
    return kept.groupBy(hour.alias("hour")).agg(
        _rows().alias("jobs_processed"), F.count_if(~F.col("success")).alias("jobs_failed"),
        ratio(F.count_if("success"), _rows(), 100).alias("success_rate"),
        F.avg("duration_ms").alias("average_processing_time"))


def throughput(perf: DataFrame, as_of: object, minutes: int = 60) -> DataFrame:
    return recent(perf, "recorded_at", as_of, minutes=minutes).agg(
        (_rows() / F.lit(minutes / 60.0)).alias("throughput"), _mean("duration_ms").alias("avg_processing_time"))


def error_rate(perf: DataFrame, as_of: object, hours: int = 24) -> DataFrame:
    return recent(perf, "recorded_at", as_of, hours=hours).agg(
        ratio(F.count_if(~F.col("success")), _rows(), 100).alias("error_rate"))


def errors_by_type(perf: DataFrame, as_of: object, minutes: int = 60) -> DataFrame:
    return recent(perf, "recorded_at", as_of, minutes=minutes).where(
        ~F.col("success") & F.col("error_type").isNotNull()).groupBy("error_type").agg(_rows().alias("errors"))


def endpoint_rates(perf: DataFrame, slow_ms: float, width: str = "minute") -> DataFrame:
    """Per operation and period: requests, failed share (4 digits), requests slower than the threshold."""
    period = F.date_trunc(width, "recorded_at").cast(perf.schema["recorded_at"].dataType)
    return perf.groupBy(F.col("operation_name").alias("endpoint"), period.alias("period")).agg(
        _rows().alias("throughput"), F.round(ratio(F.count_if(~F.col("success")), _rows()), 4).alias("error_rate"),
        F.count_if(F.col("duration_ms") > slow_ms).alias("slow_requests"))


def slow_operations(perf: DataFrame, limit: int) -> DataFrame:
    return perf.groupBy("operation_name").agg(
        _rows().alias("calls"), F.sum("duration_ms").alias("total_ms"), F.avg("duration_ms").alias("mean_ms"),
        F.max("duration_ms").alias("max_ms")).orderBy(F.desc("mean_ms"), "operation_name").limit(limit)


def metrics_summary(system: DataFrame, app: DataFrame, perf: DataFrame, alerts: DataFrame, as_of: object, hours: int = 24) -> DataFrame:
    """One row over four tables. Each is aggregated where it lies; the one-row results are stacked and merged."""
    parts = [
        recent(system, "recorded_at", as_of, hours=hours).agg(
            F.round(_mean(F.coalesce("cpu_percent", F.lit(0.0))), 2).alias("avg_cpu_percent"),
            F.round(_mean(F.coalesce("memory_percent", F.lit(0.0))), 2).alias("avg_memory_percent"),
            _rows().alias("system_points")),
        recent(app, "recorded_at", as_of, hours=hours).agg(_rows().alias("application_points")),
        recent(perf, "recorded_at", as_of, hours=hours).agg(
            _rows().alias("total_operations"),
            F.round(ratio(F.count_if("success"), _rows(), 100), 2).alias("success_rate_percent"),
            F.round(_mean("duration_ms"), 2).alias("avg_response_time_ms")),
        alerts.agg(F.count_if(F.col("status") == "active").alias("active_alerts")),
    ]
    return side_by_side(parts)


def side_by_side(parts: Sequence[DataFrame]) -> DataFrame:
    """One-row frames with different columns as one row."""
    names = [c for part in parts for c in part.columns]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in names])


def application_snapshot(perf: DataFrame, keep: int = 100) -> DataFrame:
    """Requests, errors, error share, and the mean time of the last ``keep`` successes."""
    counters = perf.agg(
        _rows().alias("total_requests"),
        F.count_if(~F.col("success") & F.col("error_type").isNotNull()).alias("total_errors"))
    latest = perf.where("success").orderBy(F.desc("recorded_at"), F.desc("metric_id")).limit(keep) \
        .agg(_mean("duration_ms").alias("avg_response_time_ms"))
    return side_by_side([counters, latest]).select(
        "total_requests", "total_errors", "avg_response_time_ms",
        ratio(F.col("total_errors"), F.col("total_requests"), 100).alias("error_rate_percent"))


def historical_means(df: DataFrame, ts: str, start: object, end: object, columns: Sequence[str]) -> DataFrame:
    kept = df.where((F.col(ts) >= moment(df, ts, start)) & (F.col(ts) <= moment(df, ts, end)))
    return kept.agg(*[_mean(c).alias(f"avg_{c}") for c in columns])


def latest(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Last row of each key; partial aggregates keep one row per key and task."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("row"))
    return best.select(key, "row.*")


def last_n(df: DataFrame, key: str, ts: str, tie: str, n: int) -> DataFrame:
    """Last n rows of each key. The rank filter is applied before the shuffle, so a hot key sends n rows per task."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie)))
    return df.withColumn("rn", rank).where(F.col("rn") <= n).drop("rn")


def stack_histories(**categories: DataFrame) -> DataFrame:
    """Rows of every category under each other, tagged; columns a category lacks are null."""
    out = None
    for name, df in categories.items():
        tagged = df.withColumn("category", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def retention_summary(tables: Mapping[str, tuple[DataFrame, str]], days: Mapping[str, int], as_of: object) -> DataFrame:
    """Per table: rows, expired, kept, oldest and newest, cut-off."""
    out = None
    for name, (df, ts) in tables.items():
        cutoff = before(df, ts, as_of, days=days.get(name, 365))
        row = df.agg(
            _rows().alias("total_records"), F.count_if(F.col(ts) < cutoff).alias("expired_records"),
            F.min(ts).alias("oldest_record"), F.max(ts).alias("newest_record"),
        ).select(
            F.lit(name).alias("data_type"), F.lit(days.get(name, 365)).cast("long").alias("retention_days"),
            "total_records", "expired_records",
            (F.col("total_records") - F.col("expired_records")).alias("active_records"),
            "oldest_record", "newest_record", cutoff.alias("cutoff_date"))
        out = row if out is None else out.unionByName(row)
    return out


def storage_usage(tables: Mapping[str, DataFrame], mb_per_row: float = 0.001) -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.agg(_rows().alias("record_count")).select(
            F.lit(name).alias("data_type"), "record_count", F.round(F.col("record_count") * mb_per_row, 3).alias("estimated_size_mb"))
        out = row if out is None else out.unionByName(row)
    return out


def sliding_rates(perf: DataFrame, width: str = "60 minutes", step: str = "5 minutes") -> DataFrame:
    """Requests, failures and mean time over overlapping windows."""
    timed = perf.withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
    return timed.groupBy(F.window("recorded_at", width, step).alias("w")).agg(
        _rows().alias("jobs_processed"), F.count_if(~F.col("success")).alias("jobs_failed"),
        F.avg("duration_ms").alias("average_processing_time"),
    ).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "jobs_processed", "jobs_failed", "average_processing_time")


def elapsed(ts: str, as_of: Column) -> Column:
    return (micros(as_of) - micros(ts)) / 1e6
