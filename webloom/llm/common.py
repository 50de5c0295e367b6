"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.session import written

__all__ = ["WORD", "add_columns", "in_cells", "kept_by_worker", "mixed", "read_table", "words_of", "written"]

#: Bytes of text that a Python worker takes on at once; a memory bound, it has no effect on results.
TOGETHER = 3_000_000
#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def kept_by_worker(key: tuple, make: Callable[[], object]) -> object:
    """A value made once in a Python worker process and kept for its later tasks (tables, caches).

    A worker serves one operator after the other and keeps the last value only: memory does not grow with a pipeline.
    """
    store = sys.modules.setdefault("_webloom_worker", types.ModuleType("_webloom_worker")).__dict__.setdefault("kept", {})
    if key not in store:
        made = make()
        store.clear()
        store[key] = made
    return store[key]


def portions(batches: Iterator[pa.RecordBatch], source: str) -> Iterator[pa.RecordBatch]:
    """The rows in smaller batches, by the size of their texts or lists in ``source``."""
    for batch in batches:
        if not len(batch):
            continue
        column = batch.column(source)
        sizes = pc.fill_null(pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column), 0)
        ends = np.cumsum(sizes.to_numpy().astype(np.int64))
        at = 0
        while at < len(batch):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + TOGETHER, side="right")))
            yield batch.slice(at, to - at)
            at = to


def add_columns(
    df: DataFrame, source: str, fields: list[T.StructField], work: Callable[[list], list[pa.Array]], keep: list[str] | None = None,
) -> DataFrame:
    """``df`` (or its columns ``keep``) with new columns made from the text column ``source``.

    ``work`` gets some texts of an Arrow batch (null as empty text; together up to ``TOGETHER`` bytes, or one
    text) and returns one array per field. A column of the input that has the name of a new one is replaced.
    """
    names = [f.name for f in fields]
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    schema = T.StructType([df.schema[c] for c in keep] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, source):
            texts = ["" if t is None else t for t in part.column(source).to_pylist()]
            made = work(texts)
            yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + made, names=keep + names)

    return df.select(*dict.fromkeys([*keep, source])).mapInArrow(run, schema)


def words_of(text: str, pattern) -> list[str]:
    return pattern.findall(text)


def in_cells(rows: DataFrame, *identity: str) -> DataFrame:
    """Rows of groups cut into ``blocks`` (a column): each row with its ``block`` and the cells (i, j) of two blocks in which
    it meets all others of its group."""
    own = F.pmod(F.xxhash64(*identity), F.col("blocks")).cast("int")
    placed = rows.withColumn("block", own).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.withColumns({"i": F.least("block", "__other"), "j": F.greatest("block", "__other")}).drop("__other", "blocks")


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x
