"""Changes to stored tables, expressed as rewrites: status logs, updates, retention."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.common import before, moment

TERMINAL = ("completed", "failed", "cancelled")

# Days that each kind of row is kept.
RETENTION_DAYS = {
    "scraped_data": 365, "job_logs": 90, "system_metrics": 30, "application_metrics": 30, "performance_metrics": 30,
    "health_checks": 7, "alerts": 180, "data_exports": 30, "user_sessions": 30, "audit_logs": 2555,
}
DEFAULT_DAYS = 365


def _last_given(column: str, order: Column) -> Column:
    """Value of the last change that sets the column."""
    return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), order))


def apply_status(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Jobs after a log of status changes (job_id, changed_at, seq, status, error_message, pages_completed, pages_failed).

    The last status holds; running sets started_at, an end status sets completed_at, other fields
    change only where given. The log is reduced to one row per job before it meets the jobs.
    """
    order = F.struct("changed_at", "seq")

    def last_time(test: Column) -> Column:
        return F.max_by("changed_at", F.when(test, order))

    latest = changes.groupBy("job_id").agg(
        F.max_by("status", order).alias("n_status"),
        last_time(F.col("status") == "running").alias("n_started"),
        last_time(F.col("status").isin(*TERMINAL)).alias("n_completed"),
        *[_last_given(c, order).alias(f"n_{c}") for c in ("error_message", "pages_completed", "pages_failed")],
        F.count_if(F.col("status") == "retry").alias("n_retries"),
    )
    retried = F.when(F.col("n_status") == "retry", "pending").otherwise(F.col("n_status"))
    out = jobs.join(latest, "job_id", "left")
    changed = {
        "status": F.coalesce(retried, F.col("status")),
        "started_at": F.coalesce("n_started", "started_at"),
        "completed_at": F.coalesce("n_completed", "completed_at"),
        "retry_count": F.col("retry_count") + F.coalesce("n_retries", F.lit(0)).cast("int"),
        **{c: F.coalesce(f"n_{c}", c) for c in ("error_message", "pages_completed", "pages_failed")},
    }
    return out.select(*[changed.get(c, F.col(c)).alias(c) for c in jobs.columns])


def matched_changes(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Whether each changed job exists: (job_id, matched)."""
    known = jobs.select("job_id", F.lit(True).alias("known"))
    return changes.select("job_id").distinct().join(known, "job_id", "left").select("job_id", F.coalesce("known", F.lit(False)).alias("matched"))


def apply_updates(base: DataFrame, updates: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Base rows with the columns of their update; rows without one stay as they are."""
    new = updates.select(key, F.struct(*columns).alias("__new"))
    out = base.join(new, key, "left")
    hit = F.col("__new").isNotNull()
    return out.select(*[F.when(hit, F.col("__new")[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def reprocess(records: DataFrame, ids: DataFrame, analyse, key: str, columns: Sequence[str]) -> DataFrame:
    """Runs ``analyse`` over the chosen records only and puts its columns in place."""
    chosen = records.join(ids.select(key).distinct(), key, "left_semi")
    return apply_updates(records, analyse(chosen), key, columns)


def change_alerts(alerts: DataFrame, requests: DataFrame) -> DataFrame:
    """Alerts after acknowledge and resolve requests (alert_id, action, requested_at); the last request sets the status."""
    last = requests.groupBy("alert_id").agg(
        F.max_by("action", "requested_at").alias("action"),
        F.max(F.when(F.col("action") == "acknowledge", F.col("requested_at"))).alias("ack"),
        F.max(F.when(F.col("action") == "resolve", F.col("requested_at"))).alias("res"))
    out = alerts.join(last, "alert_id", "left")
    status = F.when(F.col("action") == "acknowledge", "acknowledged").when(F.col("action") == "resolve", "resolved").otherwise(F.col("status"))
    columns = [c for c in alerts.columns if c not in ("status", "resolved_at")]
    return out.select(*columns, status.alias("status"), F.col("ack").alias("acknowledged_at"), F.coalesce("res", "resolved_at").alias("resolved_at"))


def days_for(kind: str, policies: Mapping[str, int] | None = None) -> int:
    return {**RETENTION_DAYS, **(policies or {})}.get(kind, DEFAULT_DAYS)


def retain(df: DataFrame, ts: str, kind: str, as_of: object, policies: Mapping[str, int] | None = None) -> DataFrame:
    """Rows young enough to be kept. With files partitioned by day this prunes whole partitions."""
    return df.where(F.col(ts) >= before(df, ts, as_of, days=days_for(kind, policies)))


def should_retain(df: DataFrame, kind: str, created: str, as_of: object, policies: Mapping[str, int] | None = None) -> Column:
    """Row-wise form for a column of kinds: created later than its policy's cut-off."""
    known = {**RETENTION_DAYS, **(policies or {})}
    days = F.coalesce(F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.lit(v))])[F.col(kind)], F.lit(DEFAULT_DAYS))
    return F.col(created) > moment(df, created, as_of) - F.make_dt_interval(days=days)


def expired_counts(tables: Mapping[str, tuple[DataFrame, str]], as_of: object, policies: Mapping[str, int] | None = None) -> DataFrame:
    """What a clean-up would delete: (data_type, expired)."""
    out = None
    for kind, (df, ts) in tables.items():
        old = F.col(ts) < before(df, ts, as_of, days=days_for(kind, policies))
        row = df.agg(F.count_if(old).alias("expired")).select(F.lit(kind).alias("data_type"), "expired")
        out = row if out is None else out.unionByName(row)
    return out


def old_jobs(jobs: DataFrame, as_of: object, days: int = 30) -> DataFrame:
    return jobs.where((F.col("created_at") < before(jobs, "created_at", as_of, days=days)) & F.col("status").isin(*TERMINAL))


def cleanup_counts(jobs: DataFrame, records: DataFrame, logs: DataFrame, as_of: object, days: int = 30) -> DataFrame:
    """Old finished jobs and the records and logs that go with them: (table, rows). Deletes nothing."""
    gone = old_jobs(jobs, as_of, days).select("job_id")
    out = gone.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("jobs").alias("table"), "rows")
    for name, child in (("records", records), ("logs", logs)):
        lost = child.join(gone, "job_id", "left_semi").agg(F.count(F.lit(1)).alias("rows"))
        out = out.unionByName(lost.select(F.lit(name).alias("table"), "rows"))
    return out


def old_metrics(tables: Mapping[str, tuple[DataFrame, str]], alerts: DataFrame, as_of: object, days: int = 30) -> DataFrame:
    """Rows of the metric tables before the cut-off, and alerts resolved before it: (data_type, expired)."""
    counts = expired_counts(tables, as_of, {k: days for k in tables})
    done = (F.col("status") == "resolved") & (F.col("resolved_at") < before(alerts, "resolved_at", as_of, days=days))
    return counts.unionByName(alerts.agg(F.count_if(done).alias("expired")).select(F.lit("alerts").alias("data_type"), "expired"))


def live_sessions(sessions: DataFrame, as_of: object) -> DataFrame:
    return sessions.where(F.col("expires_at") >= moment(sessions, "expires_at", as_of))


def orphan_files(records: DataFrame, exports: DataFrame) -> DataFrame:
    """Paths that expired records and exports leave behind; removing them is the caller's part."""
    stored = records.select(F.explode(F.array_compact(F.array_append(
        F.coalesce("file_paths", F.array().cast("array<string>")), F.col("cache_file")))).alias("path"))
    return stored.unionByName(exports.where("file_path IS NOT NULL").select(F.col("file_path").alias("path"))).distinct()


def drop_export(ledger: DataFrame, export_id: object, user_id: object) -> DataFrame:
    return ledger.where(~((F.col("export_id") == F.lit(export_id)) & (F.col("user_id") == F.lit(user_id))))
