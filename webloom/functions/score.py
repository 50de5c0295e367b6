"""Confidence of extracted data: six parts, generated from the schema of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions.cleaning import EMAIL, strip
from webloom.functions.common import col, let, total
from webloom.functions.text import looks_like_date, looks_like_price

# Weight of each part, and the names that content is expected under.
WEIGHTS = {
    "completeness": 0.25, "consistency": 0.20, "entity_confidence": 0.20, "structure_quality": 0.15,
    "content_richness": 0.10, "validation_score": 0.10,
}
KEY_NAMES = ("title", "content", "text", "name", "description")


def mean_of(*factors: tuple[Column, Column]) -> Column:
    """Mean of the values whose condition holds; each factor is (condition, value)."""
    count = total(F.when(c, 1).otherwise(0) for c, _ in factors)
    summed = total(F.when(c, v).otherwise(0.0) for c, v in factors)
    return F.when(count == 0, 0.0).otherwise(summed / F.nullif(count, F.lit(0)))


def _truthy(value: Column, kind: T.DataType) -> Column:
    """Python truth of a value: not missing, not empty, not zero."""
    if isinstance(kind, (T.ArrayType, T.MapType)):
        test = F.size(value) > 0
    elif isinstance(kind, T.StructType):
        test = value.isNotNull()
    elif isinstance(kind, T.StringType):
        test = value != ""
    elif isinstance(kind, T.BooleanType):
        test = value
    else:
        test = value != 0
    return F.coalesce(test, F.lit(False))


def _meaningful(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return F.coalesce(strip(value) != "", F.lit(False))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return _truthy(value, kind)
    return F.lit(False)


def depth(value: Column, kind: T.DataType, level: int = 0) -> Column:
    """Deepest level of nesting that the value really has."""
    if isinstance(kind, T.StructType):
        parts = [depth(value[f.name], f.dataType, level + 1) for f in kind.fields]
        inner = F.greatest(*parts) if len(parts) > 1 else parts[0]
        return F.when(value.isNull(), level).otherwise(inner)
    if isinstance(kind, T.ArrayType):
        found = F.array_max(F.transform(value, lambda x: depth(x, kind.elementType, level + 1)))
        return F.when(F.coalesce(F.size(value), F.lit(0)) > 0, found).otherwise(level)
    return F.lit(level)


def texts(value: Column, kind: T.DataType) -> Column:
    """All strings inside a value, as one array."""
    empty = F.array().cast("array<string>")
    if isinstance(kind, T.StringType):
        return F.array_compact(F.array(value))
    if isinstance(kind, T.StructType):
        parts = [texts(value[f.name], f.dataType) for f in kind.fields]
        return F.concat(*parts) if parts else empty
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType):
            return F.coalesce(F.array_compact(value), empty)
        return F.coalesce(F.flatten(F.transform(value, lambda x: texts(x, kind.elementType))), empty)
    if isinstance(kind, T.MapType):
        return texts(F.map_values(value), T.ArrayType(kind.valueType))
    return empty


def _count(flags: Sequence[Column]) -> Column:
    return total(f.cast("int") for f in flags)


def completeness(data: str, kind: T.StructType, entities: Column, raw: Column) -> Column:
    n = len(kind.fields)
    full = _count([_meaningful(F.col(f"{data}.{f.name}"), f.dataType) for f in kind.fields])
    length = F.length(raw)
    expected = F.greatest(F.least(F.floor(length / 500), F.lit(20)), F.lit(1))
    named = sum(1 for key in KEY_NAMES if any(key in f.name.lower() for f in kind.fields))
    return mean_of(
        (F.lit(n > 0), full / F.lit(float(max(n, 1)))),
        (length > 0, F.least(F.size(entities) / expected, F.lit(1.0))),
        (F.lit(True), F.lit(named / len(KEY_NAMES))),
    )


def _type_consistency(data: str, kind: T.StructType) -> Column:
    if not kind.fields:
        return F.lit(0.0)
    issues = [F.lit(0)]
    for f in kind.fields:
        value = F.col(f"{data}.{f.name}")
        if "date" in f.name.lower() and isinstance(f.dataType, T.StringType):
            issues.append((value.isNotNull() & ~looks_like_date(value)).cast("int"))
        if "price" in f.name.lower() or "cost" in f.name.lower():
            shown = F.coalesce(value.cast("string"), F.lit("None"))
            issues.append((~looks_like_price(shown)).cast("int"))
    return F.lit(1.0) - total(issues) / F.lit(float(len(kind.fields)))


def confidences(entities: Column) -> Column:
    return F.transform(entities, lambda e: F.coalesce(e["confidence"], F.lit(0.5)))


def _sum(values: Column, build=lambda v: v) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + build(v))


def consistency(data: str, kind: T.StructType, entities: Column, class_confidence: Column) -> Column:
    def spread(values: Column) -> Column:
        n = F.nullif(F.size(values), F.lit(0))
        return let(_sum(values) / n, lambda m: F.greatest(F.lit(0.0), 1 - _sum(values, lambda v: (v - m) * (v - m)) / n))

    return mean_of(
        (F.size(entities) > 0, let(confidences(entities), spread)),
        (F.lit(True), F.coalesce(class_confidence, F.lit(0.5))),
        (F.lit(True), _type_consistency(data, kind)),
    )


def entity_confidence(entities: Column) -> Column:
    def weigh(values: Column) -> Column:
        whole = _sum(values)
        return F.when(whole == 0, 0.0).otherwise(_sum(values, lambda v: v * v) / F.nullif(whole, F.lit(0.0)))

    return let(confidences(entities), weigh)


def structure_quality(data: str, kind: T.StructType) -> Column:
    if not kind.fields:
        return F.lit(0.0)
    n = float(len(kind.fields))
    deep = F.greatest(F.lit(0.0), 1 - F.abs(depth(F.col(data), kind) - 3) / 5.0)
    empty = _count([~_truthy(F.col(f"{data}.{f.name}"), f.dataType) for f in kind.fields])
    fitting = []
    for f in kind.fields:
        name, value = f.name.lower(), F.col(f"{data}.{f.name}")
        if "list" in name or "items" in name:
            fitting.append(value.isNotNull() if isinstance(f.dataType, T.ArrayType) else F.lit(False))
        elif "count" in name or "number" in name:
            fitting.append(value.isNotNull() if isinstance(f.dataType, (T.NumericType, T.BooleanType)) else F.lit(False))
        elif "url" in name or "link" in name:
            text = isinstance(f.dataType, T.StringType)
            fitting.append(F.coalesce(value.contains("http") | value.startswith("/"), F.lit(False)) if text else F.lit(False))
        else:
            fitting.append(value.isNotNull() & (value != "") if isinstance(f.dataType, T.StringType) else value.isNotNull())
    return (deep + (1 - empty / n) + _count([F.coalesce(f, F.lit(False)) for f in fitting]) / n) / 3


def content_richness(data: str, kind: T.StructType, entities: Column, raw: Column) -> Column:
    taken = F.aggregate(texts(F.col(data), kind), F.lit(0), lambda acc, x: acc + F.length(x))
    size = F.length(strip(raw))

    def shape(r: Column) -> Column:
        return F.greatest(F.lit(0.0), F.when(r < 0.3, r / 0.3).when(r <= 0.8, 1.0).otherwise(1 - (r - 0.8) / 0.2))

    kinds = F.size(F.array_distinct(F.transform(entities, lambda e: e["type"])))
    used = _count([_truthy(F.col(f"{data}.{f.name}"), f.dataType) for f in kind.fields]) if kind.fields else F.lit(0)
    return mean_of(
        (size > 0, let(F.least(taken / F.nullif(size, F.lit(0)), F.lit(1.0)), shape)),
        (F.size(entities) > 0, F.least(kinds / 5.0, F.lit(1.0))),
        (F.lit(bool(kind.fields)), F.least(used / 8.0, F.lit(1.0))),
    )


def _valid(kind: str, value: Column) -> Column:
    if kind == "EMAIL":
        return value.rlike(EMAIL)
    if kind == "URL":
        return value.rlike("^(http|https|ftp)://") & value.contains(".")
    digits = F.regexp_replace(value, r"[^\d+]", "")
    return F.length(digits).between(7, 15) & (digits.rlike(r"^\d+$") | digits.startswith("+"))


def validation(data: str, kind: T.StructType, entities: Column) -> Column:
    factors = []
    for name in ("EMAIL", "URL", "PHONE"):
        factors.append(_share_valid(entities, name))
    values = F.transform(F.filter(texts(F.col(data), kind), lambda x: F.length(strip(x)) > 3), lambda x: F.lower(strip(x)))

    def repeats(v: Column) -> Column:
        ratio = 1 - F.size(F.array_distinct(v)) / F.nullif(F.size(v), F.lit(0))
        return F.when(ratio > 0.5, 0.7).otherwise(1.0)

    return mean_of(*factors, (F.lit(True), let(values, repeats)))


def _share_valid(entities: Column, name: str) -> tuple[Column, Column]:
    own = F.filter(entities, lambda e: e["type"] == name)
    good = F.filter(own, lambda e: _valid(name, e["value"]))
    return F.size(own) > 0, F.size(good) / F.nullif(F.size(own), F.lit(0))


def confidence_breakdown(df: DataFrame, data: str, entities: str, class_confidence: Column, raw: str, factors: dict[str, float] | None = None) -> DataFrame:
    """Adds the six parts and ``confidence``. ``factors`` scale the weights of this call only."""
    kind = df.schema[data].dataType
    ents, text = col(entities), F.coalesce(col(raw), F.lit(""))
    weights = {name: w * (factors or {}).get(name, 1.0) for name, w in WEIGHTS.items()}
    parts = {
        "completeness": completeness(data, kind, ents, text),
        "consistency": consistency(data, kind, ents, class_confidence),
        "entity_confidence": entity_confidence(ents),
        "structure_quality": structure_quality(data, kind),
        "content_richness": content_richness(data, kind, ents, text),
        "validation_score": validation(data, kind, ents),
    }
    scored = df.withColumns(parts)
    whole = total(F.col(name) * F.lit(w) for name, w in weights.items())
    return scored.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), whole)))
