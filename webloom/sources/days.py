"""A stored table by day whose retention rewrites only the days that lose rows."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.session import shared_folder, written

#: Days that one DROP PARTITION statement takes; a bound on its length, no effect on results.
STEP = 200


class DayTable:
    """Rows stored by the day of ``ts``, in a managed table of the catalogue.

    Appends add files. ``retain`` drops days that are expired as a whole, without reading them, rewrites the one day
    that the cut-off falls into and leaves the files of all later days alone. Rows without a time never expire. An
    interrupted ``retain`` is run again: it finds what is left to do. Without a name the table lies in a database of
    its own in the shared folder; ``drop`` takes table and files away. The stored table may not have a column ``day``
    of its own.
    """

    def __init__(self, spark: SparkSession, ts: str, name: str | None = None):
        self.spark, self.ts = spark, ts
        if name is None:
            database = f"days_{uuid.uuid4().hex}"
            spark.sql(f"CREATE DATABASE {database} LOCATION '{shared_folder(spark)}/{database}'")
            name = f"{database}.stored"
        self.name = name

    def append(self, rows: DataFrame) -> None:
        """Adds ``rows``, which have the same columns each time."""
        if "day" in rows.columns:
            raise ValueError("the column day is the table's own")
        rows.withColumn("day", F.to_date(self.ts)).write.mode("append").format("parquet").partitionBy("day").saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name).drop("day")

    def days(self) -> list[datetime.date]:
        """Stored days, from the catalogue: one value per day, no rows are read."""
        names = [r.partition.partition("=")[2] for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect()]
        return sorted(datetime.date.fromisoformat(n) for n in names if n[:1].isdigit())

    def expiring(self, cutoff: Column) -> DataFrame:
        """Dry run: (day, rows, expired) of the days that ``retain`` would touch; later days are not read."""
        old = F.col(self.ts) < cutoff
        stored = self.spark.table(self.name).where(F.col("day") <= F.lit(self._day(cutoff)))
        counted = stored.groupBy("day").agg(F.count(F.lit(1)).alias("rows"), F.count_if(old).alias("expired"))
        return counted.where("expired > 0")

    def retain(self, cutoff: Column) -> None:
        """Deletes all rows before ``cutoff``."""
        edge = self._day(cutoff)
        gone = [d for d in self.days() if d < edge]
        kept = self.spark.table(self.name).where((F.col("day") == F.lit(edge)) & (F.col(self.ts) >= cutoff))
        old = self.spark.table(self.name).where((F.col("day") == F.lit(edge)) & (F.col(self.ts) < cutoff))
        if not old.isEmpty():
            if kept.isEmpty():
                gone.append(edge)
            else:
                # Spark refuses to overwrite what it reads: the day's rows go through a written table
                self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (day = DATE '{edge}') SELECT * FROM {{kept}}", kept=written(kept.drop("day")))
        for at in range(0, len(gone), STEP):
            listed = ", ".join(f"PARTITION (day = DATE '{d}')" for d in gone[at : at + STEP])
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS {listed}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def _day(self, cutoff: Column) -> datetime.date:
        return self.spark.range(1).select(F.to_date(cutoff)).first()[0]
