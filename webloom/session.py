"""Session settings and the places where intermediate results may be cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Partitions before costly per-row steps; set for local sessions only, whose files are small.
SCAN_PARTITIONS = "webloom.scan.partitions"


def build_session(master: str | None = None, cores: int = 8, **conf: str) -> SparkSession:
    """Session used by tests and the benchmark; on a cluster, spark-submit settings win."""
    builder = (
        SparkSession.builder.appName("webloom")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.sql.shuffle.partitions", str(cores))
            .config(SCAN_PARTITIONS, str(cores))
            .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and written intermediates.

    A cluster names it in ``spark.checkpoint.dir`` (storage every executor sees). Only where that
    is unset and all work is done by this machine, as in local tests, a scratch folder of it is taken.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="webloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: iterative operators survive lost executors and keep plans short."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, compression: str | None = None) -> DataFrame:
    """The rows as a table of the shared folder: computed once, read in part by every later step,
    and still there when executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly before a costly per-row step, where the session asks for it by ``webloom.scan.partitions``.

    Files of few row groups give few tasks; whoever knows the files sets the number. It is unset by default:
    large inputs have their splits, and nothing is executed to find out.
    """
    parts = df.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return df if df.isStreaming or not parts else df.repartition(int(parts))
