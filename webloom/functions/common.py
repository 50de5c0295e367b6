"""Small Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def moment(df: DataFrame, column: str, value: object) -> Column:
    """Literal of the column's own time type, so that the comparison reaches the scan."""
    return F.lit(str(value)).cast(df.schema[column].dataType)


def before(df: DataFrame, column: str, as_of: object, **span: int) -> Column:
    """``as_of`` minus days/hours/minutes, typed like ``column``."""
    unit, amount = next(iter(span.items()))
    return moment(df, column, as_of) - F.expr(f"INTERVAL {int(amount)} {unit.rstrip('s').upper()}")


def micros(value: Column | str) -> Column:
    return F.unix_micros(col(value).cast("timestamp"))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    return (micros(end) - micros(start)) / F.lit(1e6)


def iso(value: Column | str) -> Column:
    """ISO 8601 text; the fraction is left out where it is zero."""
    return F.regexp_replace(F.date_format(col(value), ISO), "[.]000000$", "")


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def total(values: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, values)


def ratio(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """part / whole * scale, 0.0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(
        part.cast("double") / F.nullif(whole, F.lit(0)).cast("double") * F.lit(float(scale))
    )


def clip(text: Column | str, size: int, tail: str = "...") -> Column:
    text = col(text)
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit(tail))).otherwise(text)


def python_text(value: Column, kind: T.DataType) -> Column:
    """The text form the flat exports use: True/False for flags, None for missing."""
    text = F.initcap(value.cast("string")) if isinstance(kind, T.BooleanType) else value.cast("string")
    return F.coalesce(text, F.lit("None"))


def let(value: Column, build) -> Column:
    """``build(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), build), F.lit(0))
