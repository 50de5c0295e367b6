"""Reading jobs and records: filters, projections, paging and key joins."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions.common import (
    all_of, any_of, before, clip, iso, moment, python_text, ratio, seconds_between,
)

MAX_PAGE_SIZE = 1000
ACTIVE = ("pending", "running")
FINISHED = ("completed", "failed", "cancelled")


# --- filters -------------------------------------------------------------------------------

def _instant(value: object) -> datetime:
    """A date, time or ISO text as a moment; texts without leading zeros are read too."""
    if isinstance(value, datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    text = re.sub(r"(?<!\d)(\d)(?!\d)", r"0\1", str(value).split(".")[0])
    return datetime.fromisoformat(text).replace(tzinfo=None)


def filter_records(
    df: DataFrame, *, job_ids: Sequence | None = None, urls: Sequence[str] | None = None,
    date_from: object = None, date_to: object = None, min_confidence: float = 0.0,
    min_quality: float = 0.0, content_type: str | None = None, ai_processed: bool | None = None,
    has_errors: bool | None = None,
) -> DataFrame:
    """AND of the given conditions; thresholds of 0 and missing values do not filter."""
    if date_from is not None and date_to is not None and _instant(date_to) < _instant(date_from):
        raise ValueError("date_to must not be before date_from")
    wanted: list[Column] = []
    if job_ids:
        wanted.append(F.col("job_id").isin(list(job_ids)))
    if urls:
        wanted.append(F.col("url").isin(list(urls)))
    if date_from is not None:
        wanted.append(F.col("extracted_at") >= moment(df, "extracted_at", date_from))
    if date_to is not None:
        wanted.append(F.col("extracted_at") <= moment(df, "extracted_at", date_to))
    if min_confidence > 0:
        wanted.append(F.col("confidence_score") >= min_confidence)
    if min_quality > 0:
        wanted.append(F.col("data_quality_score") >= min_quality)
    if content_type is not None:
        wanted.append(F.col("content_type") == content_type)
    if ai_processed is not None:
        wanted.append(F.col("ai_processed") == F.lit(ai_processed))
    if has_errors is not None:
        some = F.size("validation_errors") > 0
        wanted.append(some if has_errors else ~some)
    return df.where(all_of(wanted)) if wanted else df


def filter_jobs(
    df: DataFrame, *, statuses: Sequence[str] | None = None, user_id: object = None,
    max_priority: int | None = None, start: object = None, end: object = None,
) -> DataFrame:
    wanted: list[Column] = []
    if statuses:
        wanted.append(F.col("status").isin(list(statuses)))
    if user_id is not None:
        wanted.append(F.col("user_id") == F.lit(user_id))
    if max_priority is not None:
        wanted.append(F.col("priority") <= max_priority)
    if start is not None:
        wanted.append(F.col("created_at") >= moment(df, "created_at", start))
    if end is not None:
        wanted.append(F.col("created_at") <= moment(df, "created_at", end))
    return df.where(all_of(wanted)) if wanted else df


def active_jobs(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """Pending and running jobs, most urgent and oldest first."""
    found = jobs.where(F.col("status").isin(*ACTIVE)).orderBy("priority", "created_at", "job_id")
    return found if limit is None else found.limit(limit)


def recent(df: DataFrame, ts: str, as_of: object, **span: int) -> DataFrame:
    """Rows not older than hours/minutes/days before ``as_of`` (the edge itself counts)."""
    return df.where(F.col(ts) >= before(df, ts, as_of, **span))


def like_url(df: DataFrame, pattern: str, limit: int = 100) -> DataFrame:
    return df.where(F.col("url").like(pattern)).orderBy(F.desc("extracted_at"), "data_id").limit(limit)


def search_any(df: DataFrame, text: str) -> DataFrame:
    """Rows in which any column, as lower-cased text, contains the lower-cased query."""
    return df.where(any_of(
        F.coalesce(F.contains(F.lower(F.col(name).cast("string")), F.lit(text.lower())), F.lit(False))
        for name in df.columns
    ))


def by_key(df: DataFrame, key: str, value: object) -> DataFrame:
    """Point lookup: an equality the scan can prune row groups with."""
    return df.where(F.col(key) == F.lit(value))


def active_alerts(alerts: DataFrame, severity: str | None = None) -> DataFrame:
    found = alerts.where(F.col("status") == "active")
    if severity is not None:
        found = found.where(F.col("severity") == severity)
    return found.orderBy(F.desc("triggered_at"), "alert_id")


# --- order and pages -----------------------------------------------------------------------

def page(
    df: DataFrame, sort_by: str, sort_order: str = "desc", page: int = 1, page_size: int = 50, key: str = "data_id",
) -> DataFrame:
    """One page; ties are ordered by the key so that pages never overlap."""
    if not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError(f"page_size must be between 1 and {MAX_PAGE_SIZE}")
    if sort_order not in ("asc", "desc"):
        raise ValueError("sort_order must be asc or desc")
    if sort_by not in df.columns:
        raise ValueError(f"no such column: {sort_by}")
    order = F.asc(sort_by) if sort_order == "asc" else F.desc(sort_by)
    return df.orderBy(order, key).offset((page - 1) * page_size).limit(page_size)


def page_after(df: DataFrame, sort_by: str, last_value: object, last_key: object, page_size: int, key: str) -> DataFrame:
    """Next page in descending order after a known row: deep pages cost the same as the first."""
    edge = F.lit(last_value).cast(df.schema[sort_by].dataType)
    later = (F.col(sort_by) < edge) | ((F.col(sort_by) == edge) & (F.col(key) > F.lit(last_key)))
    return df.where(later).orderBy(F.desc(sort_by), key).limit(page_size)


def page_info(df: DataFrame, page: int, page_size: int) -> DataFrame:
    """One row: page, page_size, total, has_next, has_previous."""
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(page).cast("long").alias("page"),
        F.lit(page_size).cast("long").alias("page_size"),
        "total",
        (F.lit(page * page_size) < F.col("total")).alias("has_next"),
        F.lit(page > 1).alias("has_previous"),
    )


def newest(df: DataFrame, ts: str, n: int, key: str) -> DataFrame:
    return df.orderBy(F.desc(ts), key).limit(n)


# --- projections ---------------------------------------------------------------------------

def select_fields(df: DataFrame, fields: Sequence[str], content: str = "content", include_raw_html: bool = False) -> DataFrame:
    """Requested fields: a column of that name, else that field of ``content``, else left out."""
    inner = df.schema[content].dataType if content in df.columns else None
    chosen: list[Column] = []
    for name in fields:
        if name == "raw_html" and not include_raw_html:
            continue
        if name in df.columns:
            chosen.append(F.col(name))
        elif isinstance(inner, T.StructType) and name in inner.names:
            chosen.append(F.col(f"{content}.{name}").alias(name))
        elif isinstance(inner, T.MapType):
            chosen.append(F.col(content)[name].alias(name))
    return df.select(*chosen)


def without_raw_html(df: DataFrame, include_raw_html: bool = False) -> DataFrame:
    return df if include_raw_html else df.drop("raw_html")


def _texts(items: Column, kind: T.DataType) -> Column:
    return F.transform(items, lambda x: python_text(x, kind))


def flatten(df: DataFrame, map_keys: Mapping[str, Sequence[str]] = {}) -> DataFrame:
    """One level flat: nested fields become ``a_b`` text columns, lists become joined text.

    ``map_keys`` names the keys of map columns that become columns; a map without named keys becomes one
    JSON text, so that the columns never depend on the rows.
    """
    out: list[Column] = []
    for field in df.schema.fields:
        kind, value = field.dataType, F.col(field.name)
        if isinstance(kind, T.StructType):
            for inner in kind.fields:
                out.append(python_text(value[inner.name], inner.dataType).alias(f"{field.name}_{inner.name}"))
        elif isinstance(kind, T.MapType) and field.name not in map_keys:
            out.append(F.to_json(value).alias(field.name))
        elif isinstance(kind, T.MapType):
            for key in map_keys[field.name]:
                shown = python_text(value[key], kind.valueType)
                out.append(F.when(F.map_contains_key(value, key), shown).alias(f"{field.name}_{key}"))
        elif isinstance(kind, T.ArrayType):
            out.append(F.array_join(_texts(value, kind.elementType), ", ").alias(field.name))
        else:
            out.append(value)
    return df.select(*out)


def listing(records: DataFrame, jobs: DataFrame) -> DataFrame:
    """Flat list of records with the name of their job, newest first when ordered by the caller."""
    names = jobs.select("job_id", F.coalesce("name", F.lit("Unknown")).alias("job_name"))
    return records.join(names, "job_id", "left").select(
        F.col("data_id").alias("id"),
        "job_id",
        F.coalesce("job_name", F.lit("Unknown")).alias("job_name"),
        "url",
        F.coalesce("title", F.lit("No title")).alias("title"),
        F.coalesce(clip("text", 200), F.lit("")).alias("content"),
        iso("extracted_at").alias("scraped_at"),
        F.date_format("extracted_at", "yyyy-MM-dd").alias("scraped_date"),
        F.coalesce("confidence_score", F.lit(0.0)).alias("confidence_score"),
        F.coalesce("ai_processed", F.lit(False)).alias("ai_processed"),
        F.coalesce("data_quality_score", F.lit(0.0)).alias("data_quality_score"),
        F.coalesce("content_length", F.lit(0)).alias("content_length"),
        F.coalesce("content_type", F.lit("html")).alias("content_type"),
    )


def display(records: DataFrame) -> DataFrame:
    return records.select(
        F.col("data_id").alias("id"),
        clip("url", 50).alias("url"),
        F.date_format("extracted_at", "yyyy-MM-dd HH:mm").alias("extracted"),
        F.col("confidence_score").alias("confidence"),
        F.col("data_quality_score").alias("quality"),
    )


def preview(records: DataFrame, content: str = "content", fields: int = 3) -> DataFrame:
    """First fields of the content, values clipped to 1000 characters, raw html to 2000."""
    entries = F.slice(F.map_entries(content), 1, fields)
    shown = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], clip(e["value"], 1000))))
    out = records.withColumn(content, shown)
    return out.withColumn("raw_html", clip("raw_html", 2000)) if "raw_html" in records.columns else out


def job_listing(jobs: DataFrame) -> DataFrame:
    """All jobs with their defaults filled in."""
    return jobs.select(
        F.col("job_id").alias("id"),
        F.coalesce("name", F.lit("Unnamed Job")).alias("name"),
        "url",
        F.when(F.coalesce("total_pages", F.lit(0)) == 0, 1).otherwise(F.col("total_pages")).alias("max_pages"),
        "status",
        iso("created_at").alias("created_at"),
        iso("started_at").alias("started_at"),
        iso("completed_at").alias("completed_at"),
        F.coalesce("pages_completed", F.lit(0)).alias("pages_completed"),
        F.coalesce("total_pages", F.lit(0)).alias("total_pages"),
        "error_message",
        F.coalesce("retry_count", F.lit(0)).alias("retry_count"),
        F.when(F.coalesce("priority", F.lit(0)) == 0, 5).otherwise(F.col("priority")).alias("priority"),
        "user_id",
    )


def progress(jobs: DataFrame, as_of: object) -> DataFrame:
    """Share of pages done, and for running jobs the expected end at the pace so far."""
    now = moment(jobs, "started_at", as_of)
    done, all_pages = F.col("pages_completed"), F.col("total_pages")
    known = (F.col("status") == "running") & F.col("started_at").isNotNull() & (all_pages > 0) & (done > 0)
    remaining = seconds_between("started_at", now) / F.nullif(done, F.lit(0)) * (all_pages - done)
    return jobs.select(
        "job_id", "status", "priority",
        F.round(ratio(done, all_pages, 100), 2).alias("progress_percentage"),
        F.when(known, F.round(remaining, 3)).alias("eta_seconds"),
        F.when(known, now + F.make_dt_interval(secs=F.round(remaining, 3).cast("decimal(18,6)"))).alias("estimated_completion"),
    )


def conform_records(records: DataFrame, as_of: object) -> DataFrame:
    """Missing text becomes empty, the length follows the text, a confident record counts as analysed."""
    analysed = F.coalesce("ai_processed", F.lit(False)) | (F.coalesce("confidence_score", F.lit(0.0)) > 0)
    stamped = records if "processed_at" in records.columns else records.withColumn(
        "processed_at", F.lit(None).cast(records.schema["extracted_at"].dataType))
    return stamped.withColumns({
        "title": F.coalesce("title", F.lit("")),
        "text": F.coalesce("text", F.lit("")),
        "content_length": F.length(F.coalesce("text", F.lit(""))).cast("long"),
        # the time of analysis looks at the flag as delivered, before confidence raises it
        "processed_at": F.when(
            F.coalesce("ai_processed", F.lit(False)) & F.col("processed_at").isNull(),
            moment(stamped, "processed_at", as_of),
        ).otherwise(F.col("processed_at")),
        "ai_processed": analysed,
    })


def conform_jobs(jobs: DataFrame, as_of: object) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): times implied by the status are filled; more pages done than planned is an error."""
    wrong = (F.col("total_pages") > 0) & (F.col("pages_completed") > F.col("total_pages"))
    now = moment(jobs, "created_at", as_of)
    filled = jobs.withColumns({
        "completed_at": F.when((F.col("status") == "completed") & F.col("completed_at").isNull(), now)
        .otherwise(F.col("completed_at")),
        "started_at": F.when((F.col("status") == "running") & F.col("started_at").isNull(), now)
        .otherwise(F.col("started_at")),
    })
    return filled.where(~wrong), jobs.where(wrong)


# --- key joins -----------------------------------------------------------------------------

def batch_outcome(ids: DataFrame, jobs: DataFrame, operation: str) -> DataFrame:
    """Result of one bulk operation per requested job id."""
    known = jobs.select("job_id", F.col("status").alias("current"))
    if operation in ("cancel", "delete"):
        status = F.when(F.col("current").isNull(), "not_found").otherwise("success")
    else:
        status = F.lit("unsupported_operation")
    return ids.select("job_id").join(known, "job_id", "left").select("job_id", status.alias("status"))


def legal_transitions(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requests (job_id, operation) that the current status allows: cancel unless finished, retry only failed."""
    joined = requests.join(jobs.select("job_id", "status"), "job_id")
    operation, status = F.col("operation"), F.col("status")
    return joined.where(
        ((operation == "cancel") & ~status.isin(*FINISHED)) | ((operation == "retry") & (status == "failed"))
    )


def cascade_delete(keys: DataFrame, *children: DataFrame, key: str = "job_id") -> list[DataFrame]:
    """The rows that stay in each table after the parents with these keys are deleted."""
    gone = keys.select(key).distinct()
    return [child.join(gone, key, "left_anti") for child in children]


def with_parent(records: DataFrame, jobs: DataFrame, key: str = "job_id") -> DataFrame:
    return records.join(jobs.select(key), key, "left_semi")


def accept_new(new: DataFrame, existing: DataFrame, jobs: DataFrame, key: str = "data_id") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason): keys must be new and the job must exist.

    Of rows that share a new key the first by time is taken; the others are rejected too.
    """
    first = new.groupBy(key).agg(F.min(F.struct("extracted_at", "job_id", "url")).alias("first_row"))
    known_jobs = jobs.select(F.col("job_id").alias("known_job"))
    known_keys = existing.select(F.col(key).alias("known_key")).distinct()
    judged = (
        new.join(first, key)
        .join(known_keys, F.col(key) == F.col("known_key"), "left")
        .join(known_jobs, F.col("job_id") == F.col("known_job"), "left")
        .withColumn("reason", F.when(F.col("known_key").isNotNull(), "duplicate_id")
                    .when(F.struct("extracted_at", "job_id", "url") != F.col("first_row"), "duplicate_id")
                    .when(F.col("known_job").isNull(), "unknown_job"))
        .drop("known_key", "known_job", "first_row")
    )
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull())
