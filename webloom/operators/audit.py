"""Tamper-evident order of audit rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.operators.ordered import DAY, lagged


def audit_chain(rows: DataFrame, stream: str, ts: str, tie: str, seconds: int = DAY) -> DataFrame:
    """Adds previous_checksum: the checksum of the entry before in the same stream."""
    return lagged(rows, [stream], [ts, tie], {"previous_checksum": "checksum"}, seconds)


def audit_breaks(rows: DataFrame, stream: str, ts: str, tie: str, seconds: int = DAY) -> DataFrame:
    """Entries whose stored previous_checksum is not that of the entry before them."""
    out = lagged(rows, [stream], [ts, tie], {"__real": "checksum"}, seconds)
    return out.where(~F.col("previous_checksum").eqNullSafe(F.col("__real"))).drop("__real")
