"""Rule-based cleaning of records, exact duplicates, and the quality figures of a cleaning run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.cleaning import apply_rule, content_hash, prepare_text
from webloom.functions.common import ratio, total
from webloom.session import spread

KEEP_FROM = 0.3
SIMILAR_FROM = 0.85


@dataclass(frozen=True)
class CleaningRule:
    field_name: str
    rule_type: str
    parameters: Mapping = field(default_factory=dict)
    confidence_threshold: float = 0.8
    enabled: bool = True


DEFAULT_RULES = (
    CleaningRule("email", "email_validation", {"normalize_case": True}, 0.9),
    CleaningRule("phone", "phone_normalization", {"remove_formatting": True}, 0.8),
    CleaningRule("url", "url_validation", {"normalize_scheme": True, "remove_fragments": False}, 0.9),
    CleaningRule("text", "text_cleaning", {"remove_extra_whitespace": True, "normalize_unicode": True}, 0.7),
    CleaningRule("price", "price_normalization", {"currency_symbol": "$", "decimal_places": 2}, 0.8),
)


def rules_for(name: str, rules: Sequence[CleaningRule]) -> list[CleaningRule]:
    """Rules of that field, and the rules of ``text``, which hold for every field."""
    return [r for r in rules if r.enabled and r.field_name in (name, "text")]


def clean(
    records: DataFrame, fields: Sequence[str], rules: Sequence[CleaningRule] = DEFAULT_RULES, chained: bool = False,
    key: str = "data_id",
) -> DataFrame:
    """Clean the text columns ``fields`` and score every record.

    Every rule reads the original value and the last rule that changes it wins; ``chained`` lets
    each rule read the result of the one before. Adds ``field_scores``, ``corrected``,
    ``quality`` and ``keep`` (quality of at least 0.3).
    """
    applied: dict[str, Column] = {}
    names: dict[str, list[str]] = {}
    df = spread(records)
    if not chained:
        # white space first, as columns of their own: the text rule uses its result several times
        df = df.withColumns({
            f"__sq_{name}_{i}": prepare_text(F.col(name), rule.parameters)
            for name in fields for i, rule in enumerate(rules_for(name, rules)) if rule.rule_type == "text_cleaning"})
    for name in fields:
        current = F.col(name)
        names[name] = []
        for i, rule in enumerate(rules_for(name, rules)):
            step = f"__{name}_{i}"
            ready = f"__sq_{name}_{i}"
            result = apply_rule(rule.rule_type, current, rule.parameters, F.col(ready) if ready in df.columns else None)
            if chained:
                df = df.withColumn(step, result)
                current = F.col(f"{step}.value")
            applied[step] = result
            names[name].append(step)
    if not chained:
        df = df.withColumns(applied)

    cleaned: dict[str, Column] = {}
    scores: dict[str, Column] = {}
    changed: list[Column] = []
    for name in fields:
        original, value, score = F.col(name), F.col(name), F.lit(1.0)
        for step in names[name]:
            new = F.col(f"{step}.value")
            value = F.when(new != original, new).otherwise(value) if not chained else new
            score = F.least(score, F.col(f"{step}.score"))
        cleaned[name] = F.when(original.isNotNull(), value)
        scores[name] = F.when(original.isNotNull(), score)
        changed.append(F.coalesce(value != original, F.lit(False)))
    present = total(F.when(s.isNotNull(), 1).otherwise(0) for s in scores.values())
    score_sum = total(F.coalesce(s, F.lit(0.0)) for s in scores.values())
    mean = F.when(present == 0, 0.5).otherwise(score_sum / F.nullif(present, F.lit(0)))
    quality = (mean + present / F.lit(float(len(fields)))) / 2
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), s.alias("score")) for n, s in scores.items()])
    corrected = changed[0]
    for c in changed[1:]:
        corrected = corrected | c
    others = [c for c in records.columns if c not in fields]
    return df.select(
        *others, *[v.alias(n) for n, v in cleaned.items()],
        F.map_from_entries(F.filter(pairs, lambda p: p["score"].isNotNull())).alias("field_scores"),
        corrected.alias("corrected"), quality.alias("quality"), (quality >= KEEP_FROM).alias("keep"),
    )


def split_duplicates(records: DataFrame, fields: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Marks every record: ``content_hash`` and ``duplicate`` (not the first of its content).

    ``first`` is found by a partial aggregate on the hash, so a content that a third of all rows
    share sends one row per task; the flag itself comes from joining that small result back.
    """
    hashed = records.withColumn("content_hash", content_hash(**{f: F.col(f) for f in fields}))
    first = hashed.groupBy("content_hash").agg(F.min(F.struct(*order)).alias("first_seen"), F.count(F.lit(1)).alias("copies"))
    repeated = first.where("copies > 1").drop("copies")
    return hashed.join(repeated, "content_hash", "left").withColumn(
        "duplicate", F.coalesce(F.struct(*order) != F.col("first_seen"), F.lit(False))).drop("first_seen")


def keep_first(records: DataFrame, fields: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First record of each content. The rank filter runs before the shuffle as well as after it."""
    hashed = records.withColumn("content_hash", content_hash(**{f: F.col(f) for f in fields}))
    rank = F.row_number().over(Window.partitionBy("content_hash").orderBy(*order))
    return hashed.withColumn("rn", rank).where("rn = 1").drop("rn")


def cleaning_metrics(cleaned: DataFrame, duplicates: Column, fields: Sequence[str]) -> DataFrame:
    """One row for a cleaned frame in which ``duplicates`` marks later copies of a content.

    Completeness is valid / all, accuracy is 1 - errors / (5 * valid), consistency is the mean
    over fields of the mean field score of valid records. One aggregation over one scan.
    """
    valid = ~duplicates & F.col("keep")
    counts = cleaned.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(valid).alias("valid_records"),
        F.count_if(~duplicates & ~F.col("keep")).alias("invalid_records"),
        F.count_if(duplicates).alias("duplicate_records"),
        F.count_if(valid & F.col("corrected")).alias("corrected_records"),
        F.coalesce(F.sum(F.when(valid, F.size("validation_errors"))), F.lit(0)).alias("errors"),
        *[F.avg(F.when(valid, F.col("field_scores")[f])).alias(f"__score_{f}") for f in fields],
    )
    scores = [F.col(f"__score_{f}") for f in fields]
    known = total(F.when(s.isNotNull(), 1).otherwise(0) for s in scores)
    consistency = F.coalesce(total(F.coalesce(s, F.lit(0.0)) for s in scores) / F.nullif(known, F.lit(0)), F.lit(0.0))
    accuracy = F.when(F.col("valid_records") == 0, 1.0).otherwise(
        F.greatest(F.lit(0.0), 1.0 - F.col("errors") / (5.0 * F.nullif("valid_records", F.lit(0)))))
    scored = counts.withColumns({
        "completeness_score": ratio(F.col("valid_records"), F.col("total_records")),
        "accuracy_score": accuracy, "consistency_score": consistency,
    })
    return scored.drop("errors", *[f"__score_{f}" for f in fields]).withColumn(
        "overall_quality_score",
        F.col("completeness_score") * 0.4 + F.col("accuracy_score") * 0.4 + F.col("consistency_score") * 0.2)


def field_quality(cleaned: DataFrame) -> DataFrame:
    return cleaned.select(F.explode("field_scores").alias("field", "score")).groupBy("field").agg(F.avg("score").alias("score"))


# Advice given for weak figures.
ADVICE = {
    "completeness": "Consider improving data extraction rules to capture more complete records",
    "accuracy": "Review validation rules and consider additional data cleaning steps",
    "consistency": "Implement more standardized data extraction patterns",
    "duplicates": "Implement stronger duplicate detection during scraping",
    "overall": "Consider manual review of cleaning rules and extraction logic",
}


def quality_report(metrics: DataFrame) -> DataFrame:
    """The metrics row with the advice its figures call for."""
    c = F.col
    weak = {
        "completeness": c("completeness_score") < 0.8, "accuracy": c("accuracy_score") < 0.7,
        "consistency": c("consistency_score") < 0.6,
        "duplicates": c("duplicate_records") > c("total_records") * 0.1,
        "overall": c("overall_quality_score") < 0.7,
    }
    advice = F.array_compact(F.array(*[F.when(weak[k], F.lit(text)) for k, text in ADVICE.items()]))
    return metrics.withColumn("recommendations", advice)
