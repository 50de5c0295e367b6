"""Rule-based text analysis: entities, topics, categories, structure, stored AI answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.cleaning import strip
from webloom.functions.common import any_of, clip, col, let, total

# Entity patterns with the confidence each kind carries.
EMAIL_IN_TEXT = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE_IN_TEXT = r"\b(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b"
URL_IN_TEXT = r"http[s]?://[!$-_a-z]+"
PLAIN_PHONE_IN_TEXT = r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"
ENTITY_KINDS = (("EMAIL", EMAIL_IN_TEXT, 0.9), ("PHONE", PHONE_IN_TEXT, 0.8), ("URL", URL_IN_TEXT, 0.9))

# Keywords of each category, in the order that decides ties.
CATEGORIES = {
    "ecommerce": ("buy", "price", "cart", "checkout", "product", "shop", "store"),
    "news": ("breaking", "report", "today", "yesterday", "news", "article"),
    "blog": ("posted", "author", "comment", "blog", "opinion", "thoughts"),
    "corporate": ("company", "business", "services", "about us", "contact"),
    "documentation": ("guide", "tutorial", "how to", "documentation", "manual"),
    "social": ("share", "like", "follow", "comment", "social", "profile"),
}

# A word is a run of three or more plain letters with no letter, digit or _ next to it.
WORD = r"(?<![\p{L}\p{N}_])[a-z]{3,}(?![\p{L}\p{N}_])"

# Forms of dates in running text, and of dates and prices as whole values.
DATES_IN_TEXT = (
    r"(?iU)\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    r"(?iU)\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b",
    r"(?iU)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}\b",
)
DATE_VALUES = (r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}", r"\d{2}-\d{2}-\d{4}", r"[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4}")
PRICE_VALUES = (r"\$\d+\.?\d*", r"\d+\.?\d*\s*USD", r"\d+\.?\d*\s*EUR", r"£\d+\.?\d*", r"\d+\.?\d*")
# "Key: value". A key is a whole run of letters and blanks, so the search starts only where a run
# does (or at a line break, where the value before it ended) and never backs up inside one.
KEY_VALUE = r"(?U)(?:(?<![A-Za-z\s])|(?=\n))([A-Za-z\s]++):\s*([^\n]+)"


def all_matches(text: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(pattern), F.lit(0))


def entities(text: Column | str) -> Column:
    """array<struct<type, value, confidence>>: e-mails, then phones, then URLs, each once per text."""
    def found(kind: str, pattern: str, confidence: float) -> Column:
        return F.transform(
            F.array_distinct(all_matches(text, "(?U)" + pattern)),
            lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"), F.lit(confidence).alias("confidence")))

    return F.concat(*[found(*kind) for kind in ENTITY_KINDS])


def entity_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.explode(entities(text)).alias("e")).select(key, "e.*")


def words(text: Column | str) -> Column:
    return all_matches(F.lower(col(text)), WORD)


def word_count(text: Column | str) -> Column:
    return F.size(words(text))


def word_frequency(df: DataFrame, text: str, k: int = 10) -> DataFrame:
    counted = df.select(F.explode(words(text)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
    return counted.orderBy(F.desc("uses"), "word").limit(k)


def _runs(ordered: Column, k: int) -> Column:
    """The k longest runs of equal values in a sorted array: struct<neg (minus the length), word>."""
    starts = F.filter(
        F.when(F.size(ordered) > 0, F.sequence(F.lit(1), F.size(ordered))),
        lambda i: (i == 1) | (F.get(ordered, i - 1) != F.get(ordered, i - 2)))

    def lengths(at: Column) -> Column:
        return F.transform(at, lambda p, j: F.struct(
            (p - F.coalesce(F.get(at, j + 1), F.size(ordered) + 1)).alias("neg"), F.get(ordered, p - 1).alias("word")))

    return F.slice(F.array_sort(let(starts, lengths)), 1, k)


def topics(df: DataFrame, key: str, text: str, k: int = 5) -> DataFrame:
    """The k most frequent words of each record with their share of its words.

    All words of a record are in its row: they are sorted and counted there, and nothing is shuffled.
    """
    found = let(words(text), lambda w: F.struct(F.size(w).alias("n"), let(F.array_sort(w), lambda s: _runs(s, k)).alias("top")))
    rows = df.select(key, found.alias("f")).select(key, "f.n", F.posexplode("f.top").alias("place", "t"))
    uses = -F.col("t.neg").cast("long")
    return rows.select(key, (F.col("place") + 1).alias("rank"), F.col("t.word").alias("topic"), uses.alias("uses"), (uses / F.col("n")).alias("relevance"))


def classify(text: Column | str) -> Column:
    """struct<primary_category, subcategories, confidence, content_type> from keyword shares."""

    def shares(lowered: Column) -> Column:
        return F.array(*[
            F.struct(
                (total(F.contains(lowered, F.lit(w)).cast("int") for w in keywords) / F.lit(float(len(keywords)))).alias("score"),
                F.lit(-i).alias("order"), F.lit(name).alias("name"))
            for i, (name, keywords) in enumerate(CATEGORIES.items())
        ])

    def decide(scored: Column) -> Column:
        best = F.array_max(scored)
        return F.struct(
            best["name"].alias("primary_category"),
            F.transform(F.filter(scored, lambda s: s["score"] > 0.2), lambda s: s["name"]).alias("subcategories"),
            F.least(best["score"], F.lit(0.8)).alias("confidence"), F.lit("web_content").alias("content_type"))

    return let(let(F.lower(col(text)), shares), decide)


def analyse(df: DataFrame, key: str, text: str, kind: str = "comprehensive") -> DataFrame:
    """Analysis row per record; ``kind`` may narrow it to entities or classification.

    Missing text gives the error form of the row.
    """
    if kind == "entities_only":
        return df.select(key, entities(text).alias("entities"))
    if kind == "classification_only":
        return df.select(key, classify(text).alias("classification"))
    if kind != "comprehensive":
        raise ValueError(f"Unknown analysis type: {kind}")
    known = F.col(text).isNotNull()
    none = F.array().cast("array<struct<type:string,value:string,confidence:double>>")
    failed = F.struct(
        F.lit("error").alias("primary_category"), F.array().cast("array<string>").alias("subcategories"),
        F.lit(0.0).alias("confidence"), F.lit("web_content").alias("content_type"))
    return df.select(
        key,
        F.when(known, entities(text)).otherwise(none).alias("entities"),
        F.when(known, classify(text)).otherwise(failed).alias("classification"),
        F.struct(F.lit("neutral").alias("overall"), F.when(known, 0.5).otherwise(0.0).alias("score")).alias("sentiment"),
        F.when(known, clip(text, 200)).otherwise(F.lit("Analysis failed")).alias("summary"),
        F.when(known, F.lit("en")).otherwise(F.lit("unknown")).alias("language"),
        F.when(known, word_count(text)).otherwise(0).alias("word_count"),
    )


def header_lines(text: Column | str) -> Column:
    """Lines that look like headers: all capitals, ending in a colon, or of at most five words."""
    lines = F.transform(F.split(col(text), "\n"), strip)
    return F.filter(lines, lambda x: (x != "") & (
        (x.rlike(r"\p{Lu}") & ~x.rlike(r"\p{Ll}")) | x.endswith(":") | (F.size(F.split(x, r"(?U)\s+")) <= 5)))


def key_values(text: Column | str) -> Column:
    """array<struct<key, value>> of ``Key: value`` passages."""
    keys = F.regexp_extract_all(col(text), F.lit(KEY_VALUE), F.lit(1))
    values = F.regexp_extract_all(col(text), F.lit(KEY_VALUE), F.lit(2))
    return F.transform(
        F.arrays_zip(keys.alias("key"), values.alias("value")),
        lambda p: F.struct(strip(p["key"]).alias("key"), strip(p["value"]).alias("value")))


def dates(text: Column | str) -> Column:
    return F.concat(*[all_matches(text, p) for p in DATES_IN_TEXT])


def looks_like_date(value: Column | str) -> Column:
    return any_of(col(value).rlike(p) for p in DATE_VALUES)


def looks_like_price(value: Column | str) -> Column:
    return any_of(col(value).rlike(p) for p in PRICE_VALUES)


AI_SCHEMA = (
    "summary string, confidence double, quality_score double, readability_score double, topics array<string>, "
    "key_info array<string>, content_category string, language string"
)


def standard_answer(response: Column | str, enabled: Column | None = None) -> Column:
    """Stored model answer in one form: scores within 0..1, lists cut, defaults where parts lack.

    Answers that are not JSON give a partial result, empty ones a low score, ``enabled`` false a
    zero score, and a missing answer the error form.
    """
    text = strip(response)
    usable = text.rlike(r"^\{") & F.try_parse_json(text).isNotNull()
    doc = F.from_json(F.when(usable, text), AI_SCHEMA)

    def bounded(value: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.5))))

    none = F.array().cast("array<string>")

    def plain(summary: Column | str, score: float, status: str, quality: float | None = None) -> Column:
        return F.struct(
            (F.lit(summary) if isinstance(summary, str) else summary).alias("summary"),
            F.lit(score).alias("confidence"), none.alias("topics"),
            F.lit(score if quality is None else quality).alias("quality_score"),
            none.alias("key_info"), F.lit("other").alias("content_category"), F.lit("unknown").alias("language"),
            F.lit(0.5).alias("readability_score"), F.lit(status).alias("processing_status"))

    parsed = F.struct(
        F.substring(F.coalesce(doc["summary"], F.lit("")), 1, 200).alias("summary"),
        bounded(F.coalesce(doc["confidence"], doc["quality_score"])).alias("confidence"),
        F.slice(F.coalesce(doc["topics"], none), 1, 5).alias("topics"),
        bounded(doc["quality_score"]).alias("quality_score"),
        F.slice(F.coalesce(doc["key_info"], none), 1, 10).alias("key_info"),
        F.coalesce(doc["content_category"], F.lit("other")).alias("content_category"),
        F.coalesce(doc["language"], F.lit("unknown")).alias("language"),
        bounded(doc["readability_score"]).alias("readability_score"),
        F.lit("success").alias("processing_status"))
    on = F.lit(True) if enabled is None else enabled
    return (
        F.when(~on, plain("AI analysis not available - API key not configured", 0.0, "disabled", 0.5))
        .when(col(response).isNull(), plain("AI analysis failed due to error", 0.2, "error"))
        .when(text == "", plain("AI analysis returned empty response", 0.3, "empty_response"))
        .when(usable, parsed)
        .otherwise(plain(F.substring(col(response), 1, 200), 0.6, "partial_success"))
    )


def unpack(df: DataFrame, key: str, struct: Column, names: Sequence[str]) -> DataFrame:
    return df.select(key, struct.alias("s")).select(key, *[f"s.{n}" for n in names])
