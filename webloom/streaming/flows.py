"""Streams: ingest, roll-ups, keyed machines, alerts, life-cycle and file sinks.

Every flow takes a streaming DataFrame and gives one; the same function on the stored table gives
the same rows. Late rows: ten minutes behind the newest event time by default, then dropped.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from webloom.functions.cleaning import content_hash
from webloom.functions.common import before, micros
from webloom.operators.cleaning import DEFAULT_RULES, CleaningRule, clean, keep_first
from webloom.operators.pages import best_title, extract_pages
from webloom.operators.records import accept_new
from webloom.session import shared_folder
from webloom.sources.sinks import LOG_TABLES, prepare_rows

LATE = "10 minutes"
AT = "__at"


def file_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    )


def table_stream(spark: SparkSession, folder: str, table: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """A stored table as a stream, whether it is one Parquet file or a folder of them."""
    # as a pattern the path may also be that of one file
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{{{table}.parquet}}")


def event_time(df: DataFrame, ts: str, late: str = LATE) -> DataFrame:
    """Watermarks need an instant; stored times without a zone are UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def drain(stream: DataFrame, mode: str = "append", partition_by: Sequence[str] = ()) -> DataFrame:
    """Runs a stream over what is there, into a table of the shared folder, and opens that table."""
    root = f"{shared_folder(stream.sparkSession)}/drained-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{root}/checkpoint").option("path", f"{root}/table")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/table")


# --- ingest and roll-ups -------------------------------------------------------------------

def ingest(
    pages: DataFrame, rules: Sequence[CleaningRule] = DEFAULT_RULES, ts: str | None = None, late: str = LATE, **options: object,
) -> DataFrame:
    """Pages to clean records: extract, keep the first of each content, clean.

    A table keeps the first page of a content in order of time and page_id, a stream the first that arrives.
    With an event time a stream's memory for contents reaches back as far as the watermark, without one
    it keeps a hash for every content.
    """
    found = extract_pages(pages, **options).withColumn("title", best_title()).drop("metas")
    hashed = found.withColumn("content_hash", content_hash(title=F.col("title"), text=F.col("text")))
    if not pages.isStreaming:
        once = keep_first(found, ["title", "text"], [c for c in (ts, "page_id") if c and c in found.columns])
    elif ts is None:
        once = hashed.dropDuplicates(["content_hash"])
    else:
        once = event_time(hashed, ts, late).dropDuplicatesWithinWatermark(["content_hash"])
    carried = [c for c in ("page_id", "url", ts) if c and c in once.columns]
    return clean(once.select(*carried, "title", "text", "content_hash"), ["title", "text"], rules)


def rollup(perf: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = LATE) -> DataFrame:
    """Calls, failures, success share and mean time per window; a window is given once it is closed."""
    timed = event_time(perf, "recorded_at", late)
    window = F.window("recorded_at", width, slide) if slide else F.window("recorded_at", width)
    n = F.count(F.lit(1))
    return timed.groupBy(window.alias("w")).agg(
        n.alias("jobs_processed"), F.count_if(~F.col("success")).alias("jobs_failed"),
        (F.count_if("success") / n * 100).alias("success_rate"), F.avg("duration_ms").alias("average_processing_time"),
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "jobs_processed", "jobs_failed", "success_rate", "average_processing_time")


#: Columns that a batch of a stored roll-up writes per window and that later batches add to.
PARTIAL = "window_start timestamp, calls bigint, failures bigint, total_ms double, timed bigint"


def stored_rollup(perf: DataFrame, root: str, width: str = "1 hour", late_seconds: int = 600) -> None:
    """Runs the roll-up over what is there, into tables under ``root`` that ``rollup_windows`` and ``late_rows`` read.

    Each batch adds one row per window to ``partials`` and its late rows to ``late``; a batch that is run again
    replaces its own folders, so nothing counts twice. A row is late if it lies more than ``late_seconds`` behind the
    newest row of the batches before; it is stored with that limit and counts in no window. Rows without a time are left out.
    """
    spark = perf.sparkSession
    marks = f"{root}/marks"
    schema = "batch bigint, newest timestamp"
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{marks}/batch=-1")

    def add(rows: DataFrame, batch: int) -> None:
        # one value per batch before this one; later folders are left from a run that is repeated
        before_this = spark.read.schema(schema).parquet(marks).where(F.col("batch") < batch)
        newest = before_this.agg(F.unix_micros(F.max("newest"))).first()[0]
        limit = F.timestamp_micros(F.lit(newest).cast("long")) - F.make_dt_interval(secs=F.lit(late_seconds))
        timed = rows.withColumn("recorded_at", F.col("recorded_at").cast("timestamp")).where("recorded_at IS NOT NULL").withColumn("late_before", limit)
        is_late = F.coalesce(F.col("recorded_at") < F.col("late_before"), F.lit(False))
        timed.where(is_late).write.mode("overwrite").parquet(f"{root}/late/batch={batch}")
        timed.where(~is_late).groupBy(F.window("recorded_at", width)["start"].alias("window_start")).agg(
            F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("success")).alias("failures"),
            F.sum("duration_ms").alias("total_ms"), F.count("duration_ms").alias("timed"),
        ).write.mode("overwrite").parquet(f"{root}/partials/batch={batch}")
        timed.agg(F.max("recorded_at").alias("newest")).write.mode("overwrite").parquet(f"{marks}/batch={batch}")

    perf.writeStream.foreachBatch(add).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def rollup_windows(spark: SparkSession, root: str, width: str = "1 hour", late_seconds: int = 600) -> DataFrame:
    """All windows of a stored roll-up, ``is_closed`` where no row that counts can come any more; open ones are given too."""
    newest = spark.read.schema("batch bigint, newest timestamp").parquet(f"{root}/marks").agg(F.max("newest"))
    n = F.sum("calls")
    ends = F.col("window_start") + F.expr(f"INTERVAL {width}")
    closed = ends <= newest.scalar() - F.make_dt_interval(secs=F.lit(late_seconds))
    return spark.read.schema(PARTIAL).parquet(f"{root}/partials").groupBy("window_start").agg(
        n.alias("jobs_processed"), F.sum("failures").alias("jobs_failed"), ((n - F.sum("failures")) / n * 100).alias("success_rate"),
        F.try_divide(F.sum("total_ms"), F.sum("timed")).alias("average_processing_time"),
    ).withColumn("is_closed", closed)


def late_rows(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """Rows that came too late, with the limit they missed and their batch."""
    fields = [f if f.name != "recorded_at" else T.StructField("recorded_at", T.TimestampType()) for f in schema.fields]
    return spark.read.schema(T.StructType([*fields, T.StructField("late_before", T.TimestampType()), T.StructField("batch", T.LongType())])).parquet(f"{root}/late")


# --- keyed machines ------------------------------------------------------------------------

def keyed(
    events: DataFrame, key: Sequence[str], ts: str, tie: str, machine, inputs: Sequence[str], outputs: Sequence[tuple[str, T.DataType]],
    time_to_live: float | None = None, late: str = LATE,
) -> DataFrame:
    """Runs a machine per key over a stream, its state kept between batches.

    State of a key without events for as long as the machine remembers anything (its ``horizon``) is dropped,
    so the results are those of the batch form; a machine without a horizon keeps its state, unless
    ``time_to_live`` seconds are given, after which a key starts anew. Within a
    batch the events of a key are taken in order of time; the rows per batch are bounded by the
    source (``maxFilesPerTrigger``).
    """
    timed = event_time(events, ts, late).withColumn(AT, micros(ts))
    schema = T.StructType([*timed.schema.fields, *[T.StructField(n, k) for n, k in outputs]])
    names, wanted = [n for n, _ in outputs], list(inputs)
    span = getattr(machine, "horizon", None) if time_to_live is None else time_to_live
    live = None if span is None else int(span * 1000) + 1

    def step(mark: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        memory = json.loads(state.get[0]) if state.exists else machine.start()
        batch = pd.concat(list(frames)).sort_values([AT, tie], kind="stable").reset_index(drop=True)
        results = []
        for row in zip(*[batch[c].tolist() for c in wanted]):
            memory, result = machine.step(memory, *row)
            results.append(result)
        state.update((json.dumps(memory),))
        if live is not None:
            state.setTimeoutTimestamp(max(int(batch[AT].iloc[-1]) // 1000 + live, state.getCurrentWatermarkMs() + 1))
        yield pd.concat([batch, pd.DataFrame(results, columns=names)], axis=1)

    memory_schema = T.StructType([T.StructField("memory", T.StringType())])
    out = timed.groupBy(*key).applyInPandasWithState(step, schema, memory_schema, "append", GroupStateTimeout.NoTimeout if live is None else GroupStateTimeout.EventTimeTimeout)
    return out.drop(AT)


# --- life-cycle, time to live, sinks -------------------------------------------------------

# Task events with the job status they bring.
TASK_STATUS = {
    "task-sent": None, "task-received": None, "task-started": "running", "task-succeeded": "completed", "task-failed": "failed",
    "task-retried": "retry", "task-revoked": "cancelled",
}


def lifecycle(events: DataFrame) -> DataFrame:
    """Status changes from task events (job_id, event, happened_at, seq, exception)."""
    names = F.create_map(*[x for k, v in TASK_STATUS.items() if v for x in (F.lit(k), F.lit(v))])
    return events.withColumn("status", names[F.col("event")]).where("status IS NOT NULL").select(
        "job_id", F.col("happened_at").alias("changed_at"), "seq", "status",
        F.when(F.col("status") == "failed", F.coalesce("exception", F.lit("Unknown error"))).alias("error_message"),
        F.lit(None).cast("int").alias("pages_completed"), F.lit(None).cast("int").alias("pages_failed"))


def completions(events: DataFrame) -> DataFrame:
    """One row per finished task: success and run time; failed ones carry the error type."""
    ended = events.where(F.col("event").isin("task-succeeded", "task-failed"))
    ok = F.col("event") == "task-succeeded"
    return ended.select("job_id", "happened_at", ok.alias("success"), F.coalesce("runtime", F.lit(0.0)).alias("processing_time"),
                        F.when(~ok, F.lit("TASK_FAILED")).alias("error_type"))


# Seconds that each kind of stored state stays valid.
TIME_TO_LIVE = {"job": 86400, "metric": 604800, "error": 604800, "robots": 3600, "breaker": 3600}


def fresh(df: DataFrame, ts: str, kind: str, as_of: object) -> DataFrame:
    return df.where(F.col(ts) >= before(df, ts, as_of, seconds=TIME_TO_LIVE[kind]))


def cache_stats(df: DataFrame, ts: str, kind: str, as_of: object) -> DataFrame:
    valid = F.col(ts) >= before(df, ts, as_of, seconds=TIME_TO_LIVE[kind])
    return df.agg(F.count(F.lit(1)).alias("entries"), F.count_if(valid).alias("valid"), F.count_if(~valid).alias("expired"))


def append_stream(df: DataFrame, root: str, table: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None):
    """Starts the continuous append of operational rows, partitioned by day; returns the running query."""
    rows = prepare_rows(transform(df) if transform else df, table).withColumn("day", F.to_date(LOG_TABLES[table]))
    return (
        rows.writeStream.format("parquet").partitionBy("day").option("path", f"{root}/{table}")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def append_checked(rows: DataFrame, root: str, name: str, jobs: DataFrame, key: str = "data_id") -> None:
    """Appends what a stream has to the records under ``root``, each key once and only with a known job.

    Every batch writes its accepted and its rejected rows (with a reason) to folders of its own, ``stream=name/batch=n``:
    they are the ledger, a batch that is run again replaces them and is judged against the same earlier rows, so it
    changes nothing. Streams that share ``root`` see each other's rows; they must not run at the same time.
    ``stored_records`` and ``stored_rejects`` read the tables.
    """
    spark, stored = rows.sparkSession, T.StructType([rows.schema[key], *STORED_IN])
    # an empty batch, so that there is a table to read
    rows.sparkSession.createDataFrame([], rows.schema).write.mode("overwrite").parquet(f"{root}/records/stream={name}/batch=-1")

    def add(new: DataFrame, batch: int) -> None:
        earlier = spark.read.schema(stored).parquet(f"{root}/records").where((F.col("stream") != name) | (F.col("batch") < batch))
        good, bad = accept_new(new.distinct(), earlier.select(key), jobs, key)
        good.write.mode("overwrite").parquet(f"{root}/records/stream={name}/batch={batch}")
        bad.write.mode("overwrite").parquet(f"{root}/rejects/stream={name}/batch={batch}")

    rows.writeStream.foreachBatch(add).option("checkpointLocation", f"{root}/checkpoint-{name}").trigger(availableNow=True).start().awaitTermination()


#: Where a stored row came from.
STORED_IN = (T.StructField("stream", T.StringType()), T.StructField("batch", T.LongType()))


def stored_records(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema, *STORED_IN])).parquet(f"{root}/records")


def stored_rejects(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """Rejected rows with their reason (``duplicate_id``, ``unknown_job``)."""
    return spark.read.schema(T.StructType([*schema, T.StructField("reason", T.StringType()), *STORED_IN])).parquet(f"{root}/rejects")


def export_chunks(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Hands every micro-batch to ``write(rows, batch id)``; a repeated batch comes with the same id."""
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

