"""Writing results: exports with a manifest, append with checks, operational rows."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.operators.records import filter_records, flatten, select_fields, without_raw_html

FORMATS = ("csv", "json", "parquet")
EMPTY_HEADER = ("id", "job_id", "url", "extracted_at")
MANIFEST = (
    "export_id string, user_id string, format string, filters string, status string, file_path string, records bigint, "
    "requested_at timestamp, completed_at timestamp, error_message string, file_size bigint"
)
#: States of an export in order; the last two are final.
STATES = ("pending", "processing", "completed", "failed")


def shaped(df: DataFrame, fmt: str, fields: Sequence[str] | None = None, include_raw_html: bool = False) -> DataFrame:
    """Columns of an export: the chosen fields, flat and in name order for CSV."""
    out = select_fields(df, fields, include_raw_html=include_raw_html) if fields else without_raw_html(df, include_raw_html)
    if fmt != "csv":
        return out
    flat = flatten(out)
    return flat.select(*sorted(flat.columns)) if flat.columns else df.sparkSession.createDataFrame(
        [], ", ".join(f"{c} string" for c in EMPTY_HEADER))


def export(
    df: DataFrame, path: str, fmt: str, *, user_id: str = "", fields: Sequence[str] | None = None, include_raw_html: bool = False,
    compress: bool = False, max_records: int | None = None, order_by: str | None = None, ledger: str | None = None, export_id: str | None = None,
    **filters: object,
) -> DataFrame:
    """Writes an export and returns its one-row manifest.

    With a ``ledger`` each state (``STATES``) is appended to it as it is reached, so an export that a lost driver left
    behind stays visible as pending or processing; ``export_status`` reads the latest.

    Executors write the part files; the row count is observed during the write, so the data is
    read once. ``max_records`` bounds the rows per file, for exports in chunks; by default a task
    writes one file. ``order_by`` range-partitions, so parts in
    name order are in order without one task holding all rows.
    """
    if fmt not in FORMATS:
        raise ValueError(f"Unsupported export format: {fmt}")
    if max_records is not None and not 100 <= max_records <= 10_000_000:
        raise ValueError("max_records out of range")
    spark = df.sparkSession
    export_id = export_id or str(uuid.uuid4())
    seen = Observation(f"export-{export_id}")
    status, error, count, size, ended = "pending", None, None, None, None
    started = spark.sql("SELECT current_timestamp() AS t").first().t

    def reached() -> DataFrame:
        file_path = path if status == "completed" else None
        row = spark.createDataFrame([(export_id, user_id, fmt, repr(dict(filters)), status, file_path, count, started, ended, error, size)], MANIFEST)
        if ledger:
            row.write.mode("append").parquet(ledger)
        return row

    reached()
    status = "processing"
    reached()
    try:
        rows = filter_records(df, **filters) if filters else df
        if order_by:
            rows = rows.repartitionByRange(order_by).sortWithinPartitions(order_by)
        rows = shaped(rows, fmt, fields, include_raw_html).observe(seen, F.count(F.lit(1)).alias("n"))
        writer = rows.write.mode("overwrite").option("maxRecordsPerFile", max_records or 0)
        if compress and fmt != "parquet":
            writer = writer.option("compression", "gzip")
        if fmt == "csv":
            writer = writer.option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "")
        writer.format(fmt).save(path)
        count = seen.get["n"]
        # lengths only: the content column is pruned, no file is read
        size = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        status = "completed"
    except Exception as fault:  # the manifest records the failure; the caller decides
        status, error = "failed", str(fault)
    ended = spark.sql("SELECT current_timestamp() AS t").first().t
    return reached()


def report(df: DataFrame, path: str, fmt: str = "csv") -> DataFrame:
    """Two tables side by side: the data and a summary (Total Records, Generated At, Format)."""
    manifest = export(df, f"{path}/data", fmt)
    row = manifest.first()
    summary = df.sparkSession.createDataFrame(
        [("Total Records", str(row.records)), ("Generated At", row.completed_at.isoformat()), ("Format", fmt)], "name string, value string")
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/summary")
    return manifest


def latest_states(ledger: DataFrame) -> DataFrame:
    """One row per export of a ledger: the furthest state it has reached."""
    place = F.array_position(F.array(*map(F.lit, STATES)), F.col("status"))
    rows = ledger.groupBy("export_id").agg(F.max_by(F.struct(*ledger.columns), place).alias("r"))
    return rows.select("r.*")


def export_status(ledger: DataFrame, user_id: str, export_id: str | None = None, status: str | None = None) -> DataFrame:
    """Latest state of a user's exports, or of one of them; with ``status`` only those that are in it now."""
    own = ledger.where(F.col("user_id") == user_id)
    found = latest_states(own if export_id is None else own.where(F.col("export_id") == export_id))
    return found if status is None else found.where(F.col("status") == status)


# The tables that operational rows go to, with their time column.
LOG_TABLES: Mapping[str, str] = {
    "job_logs": "created_at", "system_metrics": "recorded_at", "application_metrics": "recorded_at",
    "performance_metrics": "recorded_at", "health_checks": "checked_at", "alerts": "triggered_at",
}


def prepare_rows(df: DataFrame, table: str) -> DataFrame:
    """Normal form of rows before they are appended: levels in capitals, contexts never null."""
    if table == "job_logs":
        context = F.coalesce("context", F.create_map().cast(T.MapType(T.StringType(), T.StringType()))) if "context" in df.columns \
            else F.create_map().cast(T.MapType(T.StringType(), T.StringType()))
        return df.withColumns({"level": F.upper("level"), "context": context})
    if table == "system_metrics":
        name = F.col("metric_name") if "metric_name" in df.columns else F.lit(None).cast("string")
        value = F.col("metric_value") if "metric_value" in df.columns else F.lit(None).cast("double")
        # a whole snapshot is stored under one name, its value is the processor load
        return df.withColumns({"metric_name": F.coalesce(name, F.lit("system_snapshot")), "metric_value": F.coalesce(value, F.col("cpu_percent"))})
    if table == "alerts":
        return df.withColumn("status", F.lit("active"))
    return df


def append_rows(df: DataFrame, root: str, table: str) -> None:
    """Appends to a table partitioned by day, so that time filters and retention prune whole folders."""
    ts = LOG_TABLES[table]
    prepare_rows(df, table).withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").parquet(f"{root}/{table}")


def seed_jobs(urls: DataFrame, valid: Column, config: Mapping[str, str], priority: int = 5, tags: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(jobs, rejected): one pending job per valid URL, its id derived from the URL so that reruns agree."""
    shared = F.create_map(*[x for k, v in config.items() for x in (F.lit(k), F.lit(v))]) if config else F.create_map().cast("map<string,string>")
    jobs = urls.where(valid).select(
        F.xxhash64("url").alias("job_id"), "url", F.lit("pending").alias("status"), F.lit(priority).alias("priority"),
        F.array(*[F.lit(x) for x in tags]).cast("array<string>").alias("tags"), shared.alias("config"), F.lit(0).alias("total_pages"))
    return jobs, urls.where(~valid)
