"""Field cleaning: each rule turns a text column into ``struct<value, score>``."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions.common import col, let

# The accepted forms of e-mail addresses and phone numbers.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE = r"^\+?[1-9]\d{0,15}$"
PRICE = r"[\d,]+\.?\d*"

SPACE = r"(?U)\s+"
EDGE_SPACE = r"(?U)^\s+|\s+$"

Rule = Callable[..., Column]


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Compatibility form. Spark has no such function; plain ASCII text never leaves the JVM."""
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def strip(text: Column | str) -> Column:
    return F.regexp_replace(col(text), EDGE_SPACE, "")


def squeeze(text: Column | str) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(col(text), SPACE, " "))


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{L}+", ""))


def scored(value: Column, score: Column) -> Column:
    return F.struct(value.alias("value"), score.cast("double").alias("score"))


def _filled(original: Column, value: Column, score) -> Column:
    """The rule's result; empty text keeps its value and scores 0."""
    return let(value, lambda v: scored(
        F.when(original == "", original).otherwise(v), F.when(original == "", 0.0).otherwise(score(v))))


def clean_email(text: Column, options: Mapping = {}, prepared: Column | None = None) -> Column:
    value = strip(text)
    if options.get("normalize_case", True):
        value = F.lower(value)

    def score(v: Column) -> Column:
        near = v.contains("@") & F.substring_index(v, "@", -1).contains(".")
        return F.when(v.rlike(EMAIL), 1.0).when(near, 0.7).otherwise(0.2)

    return _filled(text, value, score)


def clean_phone(text: Column, options: Mapping = {}, prepared: Column | None = None) -> Column:
    value = strip(text)
    if options.get("remove_formatting", True):
        value = F.regexp_replace(value, r"(?U)[\s\-().]", "")

    def judge(v: Column) -> Column:
        digits = F.regexp_replace(v, r"\D", "")
        return F.when(v.rlike(PHONE), scored(v, F.lit(1.0))).when(F.length(digits).between(7, 15), scored(digits, F.lit(0.8))) \
            .otherwise(scored(v, F.lit(0.2)))

    return F.when(text == "", scored(text, F.lit(0.0))).otherwise(let(value, judge))


def clean_url(text: Column, options: Mapping = {}, prepared: Column | None = None) -> Column:
    def complete(v: Column) -> Column:
        web = v.startswith("http://") | v.startswith("https://")
        return (
            F.when(web, v).when(v.startswith("//"), F.concat(F.lit("https:"), v))
            .when(v.contains("."), F.concat(F.lit("https://"), v)).otherwise(v)
        )

    value = let(strip(text), complete) if options.get("normalize_scheme", True) else strip(text)
    if options.get("remove_fragments", False):
        value = F.substring_index(value, "#", 1)
    return _filled(text, value, lambda v: F.when(v.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+"), 1.0).otherwise(0.4))


def clean_text(text: Column, options: Mapping = {}, prepared: Column | None = None) -> Column:
    """``prepared`` may hand in the squeezed text as a column, so that it is computed only once."""
    value = prepared if prepared is not None else prepare_text(text, options)
    if options.get("normalize_unicode", True):
        value = nfkc(value)

    def score(v: Column) -> Column:
        size = F.length(v)
        return F.when(size == 0, 0.0).when(size < 3, 0.5).when(letters(v) > size * 0.3, 0.9).otherwise(0.6)

    return _filled(text, value, score)


def prepare_text(text: Column, options: Mapping = {}) -> Column:
    return squeeze(text) if options.get("remove_extra_whitespace", True) else text


def clean_price(text: Column, options: Mapping = {}, prepared: Column | None = None) -> Column:
    places, symbol = int(options.get("decimal_places", 2)), options.get("currency_symbol", "$") or ""

    def judge(v: Column) -> Column:
        found = F.regexp_extract(v, PRICE, 0)
        amount = F.regexp_replace(found, ",", "").try_cast("double")
        shown = F.concat(F.lit(symbol), F.format_string(f"%.{places}f", amount))
        return F.when(amount.isNotNull(), scored(shown, F.lit(0.9))).when(found != "", scored(v, F.lit(0.3))).otherwise(scored(v, F.lit(0.1)))

    return F.when(text == "", scored(text, F.lit(0.0))).otherwise(let(strip(text), judge))


# Rule types by name; ``register_rule`` adds to them.
RULES: dict[str, Rule] = {
    "email_validation": clean_email,
    "phone_normalization": clean_phone,
    "url_validation": clean_url,
    "text_cleaning": clean_text,
    "price_normalization": clean_price,
}


def register_rule(name: str, rule: Callable[[Column, Mapping], Column]) -> None:
    """Add a rule type: ``rule(text column, options) -> struct<value, score>``."""
    RULES[name] = lambda text, options, prepared=None: rule(text, options)


def apply_rule(name: str, text: Column, options: Mapping, prepared: Column | None = None) -> Column:
    rule = RULES.get(name)
    return scored(text, F.lit(0.5)) if rule is None else rule(text, options, prepared)


def content_hash(**fields: Column) -> Column:
    """md5 over the fields in name order; missing and empty values differ."""
    parts = [F.concat(F.lit(f"{name}="), F.coalesce(F.to_json(F.array(fields[name].cast("string"))), F.lit("")))
             for name in sorted(fields)]
    return F.md5(F.concat_ws("\n", *parts))


def map_hash(content: Column | str) -> Column:
    """md5 of a map column, independent of the order of its keys."""
    return F.md5(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(col(content))))))
