"""Streams fed in several batches give what the batch form gives."""

import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions.machines import AdaptiveLimit, Breaker, Notifier, SlidingLimit, TokenBucket
from webloom.operators import events as E
from webloom.sources.days import DayTable
from webloom.streaming import flows as S

B, D, L, STR = T.BooleanType(), T.DoubleType(), T.LongType(), T.StringType()


@pytest.fixture(scope="module")
def parts(spark, tables, tmp_path_factory):
    """Events cut by time into files that arrive one after the other."""
    folder = str(tmp_path_factory.mktemp("events"))
    e = tables["events"].select(
        F.col("event_id").alias("id"), "ts", F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("k"),
        (F.col("event_type") != "error").alias("ok"), F.col("event_type").alias("kind"), (F.col("value") / 60).alias("v"))
    for n in range(3):
        e.where((F.col("id") % 1000 >= n * 334) & (F.col("id") % 1000 < (n + 1) * 334)).coalesce(1).write.mode("append").parquet(folder)
    return folder, e


def run(spark, parts, key, machine, inputs, outputs, **more):
    stream = S.file_stream(spark, parts[0], "*.parquet", parts[1].schema, files_per_batch=1)
    return S.drain(S.keyed(stream, key, "ts", "id", machine, inputs, outputs, late="40 days", **more))


def rows(df, *cols):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select("id", *cols).collect())


def test_sliding_limit(spark, parts):
    got = run(spark, parts, ["k"], SlidingLimit(3, 7200), [S.AT], [("allowed", B), ("retry_after", L)])
    assert rows(got, "allowed", "retry_after") == rows(E.rate_limit(parts[1], "k", "ts", "id", 3, 7200), "allowed", "retry_after")


def test_token_bucket(spark, parts):
    got = run(spark, parts, ["k"], TokenBucket(3.0, 0.0002), [S.AT], [("taken", B), ("tokens", D)])
    assert rows(got, "taken", "tokens") == rows(E.token_bucket(parts[1], "k", "ts", "id", 3.0, 0.0002), "taken", "tokens")


def test_adaptive_limit(spark, parts):
    e = parts[1].withColumns({"load": F.col("v"), "errors": F.col("v") / 10})
    got = run(spark, (parts[0], parts[1]), ["k"], AdaptiveLimit(100), [S.AT, "v", "v"], [("factor", D), ("current_limit", L)])
    want = E.adaptive_limit(parts[1], "k", "ts", "id", 100, "v", "v")
    assert rows(got, "factor", "current_limit") == rows(want, "factor", "current_limit") and e.count() > 0


def test_breaker(spark, parts):
    config = Breaker(2, 2, 600.0, 7200.0)
    got = run(spark, parts, ["k"], config, [S.AT, "ok"], [("state_before", STR), ("state", STR), ("blocked", B)])
    assert rows(got, "state", "blocked") == rows(E.breaker(parts[1], "k", "ts", "id", "ok", config), "state", "blocked")


def test_notifier(spark, parts):
    config = Notifier(2, 7200.0, 1800.0)
    got = run(spark, parts, ["k"], config, [S.AT, "kind"], [("outcome", STR)])
    assert rows(got, "outcome") == rows(E.notify(parts[1], "ts", "id", "kind", config, ["k"]), "outcome")


def test_state_is_dropped_after_its_time(spark, parts):
    """With a time to live of zero only the events of one batch share a state; nothing breaks."""
    got = run(spark, parts, ["k"], SlidingLimit(1, 10**7), [S.AT], [("allowed", B), ("retry_after", L)], time_to_live=0.0)
    assert got.count() == parts[1].count()


@pytest.mark.parametrize("files", [0, 1, 3])
def test_table_of_one_or_many_files_is_streamed_whole(spark, tmp_path, files):
    """A table may be a file (0: as such, else a folder of so many)."""
    from webloom.plans.registry import QUERIES
    from webloom.plans import load

    load()
    df = spark.createDataFrame([(i, "en", "x" * i) for i in range(7)], "doc_id long, lang string, text string")
    df.repartition(max(files, 1)).write.parquet(str(tmp_path / ("documents.parquet" if files else "made")))
    if not files:
        shutil.copy(next((tmp_path / "made").glob("*.parquet")), tmp_path / "documents.parquet")
    got = QUERIES["a15_stream_export"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(i, "en", i) for i in range(7)]
    assert sorted(r.doc_id for r in S.drain(S.table_stream(spark, str(tmp_path), "documents", df.schema)).collect()) == list(range(7))


def test_stored_rollup_counts_a_repeated_batch_once(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "recorded_at timestamp, success boolean, duration_ms double"

    def arrive(*minutes):
        rows = [(m, m % 2 == 0, None if m == 61 else float(m)) for m in minutes]
        df = spark.createDataFrame(rows, "m int, success boolean, duration_ms double")
        df = df.select(F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, m)").alias("recorded_at"), "success", "duration_ms")
        df.coalesce(1).write.mode("append").parquet(source)
        S.stored_rollup(S.file_stream(spark, source, "*.parquet", df.schema), root)

    def windows():
        rows = S.rollup_windows(spark, root).orderBy("window_start").collect()
        return [(r.window_start.hour, r.jobs_processed, r.jobs_failed, r.average_processing_time, r.is_closed) for r in rows]

    arrive(2, 4, 61)
    assert windows() == [(0, 2, 0, 3.0, False), (1, 1, 1, None, False)]
    arrive(50, 51, 130)  # 50 is eleven minutes behind 61, 51 just in time
    expected = [(0, 3, 1, 19.0, True), (1, 1, 1, None, True), (2, 1, 0, 130.0, False)]
    assert windows() == expected
    for name in ("1", ".1.crc"):
        (tmp_path / "out" / "checkpoint" / "commits" / name).unlink()
    arrive(131)
    expected[2] = (2, 2, 1, 130.5, False)
    assert windows() == expected
    late = S.late_rows(spark, root, spark.read.parquet(source).schema).collect()
    assert [(r.duration_ms, r.batch, r.late_before.minute) for r in late] == [(50.0, 1, 51)]


def test_checked_append_run_again_changes_nothing(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    jobs = spark.createDataFrame([(1,)], "job_id int")

    def arrive(*rows, name="a"):
        df = spark.createDataFrame(rows, "data_id int, job_id int, extracted_at string, url string")
        df.coalesce(1).write.mode("append").parquet(source)
        S.append_checked(S.file_stream(spark, source, "*.parquet", df.schema), root, name, jobs)
        return df.schema

    def state(schema):
        kept = sorted((r.data_id, r.url, r.batch) for r in S.stored_records(spark, root, schema).collect())
        lost = sorted((r.data_id, r.url, r.reason) for r in S.stored_rejects(spark, root, schema).collect())
        return kept, lost

    arrive((1, 1, "t1", "x"), (1, 1, "t1", "x"), (1, 1, "t2", "y"), (2, 9, "t1", "x"))
    schema = arrive((1, 1, "t0", "z"), (2, 1, "t1", "z"), (3, 1, "t1", "z"))
    expected = ([(1, "x", 0), (2, "z", 1), (3, "z", 1)], [(1, "y", "duplicate_id"), (1, "z", "duplicate_id"), (2, "x", "unknown_job")])
    assert state(schema) == expected
    for name in ("1", ".1.crc"):
        (tmp_path / "out" / "checkpoint-a" / "commits" / name).unlink()
    S.append_checked(S.file_stream(spark, source, "*.parquet", schema), root, "a", jobs)
    assert state(schema) == expected


def test_retention_rewrites_one_day_only(spark):
    table = DayTable(spark, "at")
    rows = [(d, h) for d in range(1, 6) for h in (1, 13)]
    df = spark.createDataFrame(rows, "d int, h int").select("d", "h", F.make_timestamp_ntz(F.lit(2024), F.lit(1), "d", "h", F.lit(0), F.lit(0)).alias("at"))
    table.append(df.unionByName(df.limit(1).withColumn("at", F.lit(None).cast("timestamp_ntz"))))
    files = {(r.d, r.f) for r in spark.table(table.name).select("d", F.col("_metadata.file_path").alias("f")).collect()}
    cut = F.expr("TIMESTAMP_NTZ '2024-01-03 12:00:00'")
    assert sorted((r.day.day, r["rows"], r.expired) for r in table.expiring(cut).collect()) == [(1, 2, 2), (2, 2, 2), (3, 2, 1)]
    for _ in range(2):  # the second run finds nothing to do
        table.retain(cut)
        left = spark.table(table.name).select("d", "h", "at", F.col("_metadata.file_path").alias("f")).collect()
        assert sorted((r.d, r.h) for r in left if r.at) == [(3, 13), (4, 1), (4, 13), (5, 1), (5, 13)]
        assert sum(r.at is None for r in left) == 1 and [d.day for d in table.days()] == [3, 4, 5]
        assert all((r.d, r.f) in files for r in left if r.d > 3) and not any((r.d, r.f) in files for r in left if r.d == 3)
    table.retain(F.expr("TIMESTAMP_NTZ '2024-01-04 13:30:00'"))  # nothing of its day is left
    assert [d.day for d in table.days()] == [5] and table.rows().count() == 3
    with pytest.raises(ValueError):
        table.append(df.withColumn("day", F.lit(1)))
    table.drop()
