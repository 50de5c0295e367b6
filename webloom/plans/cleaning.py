"""Cleaning rules, exact duplicates and the figures of a cleaning run."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.functions import cleaning as C
from webloom.operators import cleaning as O
from webloom.plans.registry import query

WS = r"[\s\x0b\x{85}\p{Z}]"


def strip_sql(c):
    return f"regexp_replace(regexp_replace({c}, '^{WS}+', ''), '{WS}+$', '')"


def text_value(c):
    return f"CASE WHEN {c} = '' THEN {c} ELSE regexp_replace({strip_sql(c)}, '{WS}+', ' ', 'g') END"


def text_score(c):
    v = text_value(c)
    letters = f"length(regexp_replace({v}, '\\P{{L}}+', '', 'g'))"
    return f"CASE WHEN length({v}) = 0 THEN 0.0 WHEN length({v}) < 3 THEN 0.5 WHEN {letters} > length({v}) * 0.3 THEN 0.9 ELSE 0.6 END::DOUBLE"


def email_value(c):
    return f"CASE WHEN {c} = '' THEN {c} ELSE lower({strip_sql(c)}) END"


def email_score(c):
    v = f"lower({strip_sql(c)})"
    return (f"CASE WHEN {c} = '' THEN 0.0 WHEN regexp_full_match({v}, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}') THEN 1.0 "
            f"WHEN contains({v}, '@') AND contains(regexp_extract({v}, '[^@]*$'), '.') THEN 0.7 ELSE 0.2 END::DOUBLE")


def _phone(c):
    return f"regexp_replace({strip_sql(c)}, '[\\s\\-().]', '', 'g')"


def phone_value(c):
    v = _phone(c)
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    return f"CASE WHEN {c} = '' THEN {c} WHEN NOT regexp_full_match({v}, '\\+?[1-9][0-9]{{0,15}}') AND length({d}) BETWEEN 7 AND 15 THEN {d} ELSE {v} END"


def phone_score(c):
    v = _phone(c)
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    return f"CASE WHEN {c} = '' THEN 0.0 WHEN regexp_full_match({v}, '\\+?[1-9][0-9]{{0,15}}') THEN 1.0 WHEN length({d}) BETWEEN 7 AND 15 THEN 0.8 ELSE 0.2 END::DOUBLE"


def url_value(c):
    v = strip_sql(c)
    return (f"CASE WHEN {c} = '' THEN {c} WHEN {v} LIKE 'http://%' OR {v} LIKE 'https://%' THEN {v} WHEN {v} LIKE '//%' THEN concat('https:', {v}) "
            f"WHEN contains({v}, '.') THEN concat('https://', {v}) ELSE {v} END")


def url_score(c):
    return f"CASE WHEN {c} = '' THEN 0.0 WHEN regexp_matches({url_value(c)}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+') THEN 1.0 ELSE 0.4 END::DOUBLE"


def _amount(c):
    return f"TRY_CAST(replace(regexp_extract({strip_sql(c)}, '[0-9,]+\\.?[0-9]*'), ',', '') AS DOUBLE)"


def price_value(c):
    return f"CASE WHEN {c} = '' THEN {c} WHEN {_amount(c)} IS NOT NULL THEN concat('$', printf('%.2f', {_amount(c)})) ELSE {strip_sql(c)} END"


def price_score(c):
    return f"CASE WHEN {c} = '' THEN 0.0 WHEN {_amount(c)} IS NOT NULL THEN 0.9 WHEN regexp_extract({strip_sql(c)}, '[0-9,]+\\.?[0-9]*') <> '' THEN 0.3 ELSE 0.1 END::DOUBLE"


FIELD_SQL = {
    "email": (email_value, email_score), "phone": (phone_value, phone_score), "url": (url_value, url_score),
    "text": (text_value, text_score), "price": (price_value, price_score),
}


def _one(name, value, score):
    return f"SELECT data_id, {value(name)} AS value, CASE WHEN {name} IS NOT NULL THEN {score(name)} END AS score FROM v_contacts"


def _field(t, name, rule, options={}):
    df = t.contacts().select("data_id", name, rule(F.col(name), options).alias("r"))
    known = F.col(name).isNotNull()
    return df.select("data_id", F.when(known, F.col("r.value")).alias("value"), F.when(known, F.col("r.score")).alias("score"))


@query("j1_clean_email", _one("email", email_value, email_score), ["v_contacts"])
def j1(t):
    return _field(t, "email", C.clean_email)


@query("j2_clean_phone", _one("phone", phone_value, phone_score), ["v_contacts"])
def j2(t):
    return _field(t, "phone", C.clean_phone)


@query("j3_clean_url", _one("url", url_value, url_score), ["v_contacts"])
def j3(t):
    return _field(t, "url", C.clean_url)


@query("j4_clean_text", f"SELECT doc_id AS data_id, {text_value('text')} AS value, {text_score('text')} AS score FROM documents")
def j4(t):
    docs = t.texts().select(F.col("doc_id").alias("data_id"), "text", C.prepare_text(F.col("text")).alias("sq"))
    df = docs.select("data_id", C.clean_text(F.col("text"), prepared=F.col("sq")).alias("r"))
    return df.select("data_id", "r.value", "r.score")


@query("j5_clean_price", _one("price", price_value, price_score), ["v_contacts"])
def j5(t):
    return _field(t, "price", C.clean_price, {"currency_symbol": "$", "decimal_places": 2})


# Each rule reads the original value, the text rule holds for every field, the last change wins.
_STEPS = {"email": ["email", "text"], "phone": ["phone", "text"], "url": ["url", "text"], "text": ["text"], "price": ["text", "price"]}


def _cleaned_sql():
    cols = []
    for f, steps in _STEPS.items():
        value = f
        for s in steps:
            v = FIELD_SQL[s][0](f)
            value = f"CASE WHEN {v} <> {f} THEN {v} ELSE {value} END"
        score = "least(" + ", ".join(["1.0::DOUBLE"] + [FIELD_SQL[s][1](f) for s in steps]) + ")"
        cols.append(f"CASE WHEN {f} IS NOT NULL THEN {value} END AS {f}, CASE WHEN {f} IS NOT NULL THEN {score} END AS s_{f}, {f} AS o_{f}")
    return f"SELECT data_id, {', '.join(cols)} FROM v_contacts"


FIELDS = list(_STEPS)
_N = " + ".join(f"(s_{f} IS NOT NULL)::INT" for f in FIELDS)
_S = " + ".join(f"coalesce(s_{f}, 0.0)" for f in FIELDS)
CLEAN_SQL = f"""
WITH c AS ({_cleaned_sql()})
SELECT data_id, email, phone, url, text, price, {', '.join(f'round(s_{f}, 9) AS score_{f}' for f in FIELDS)},
 ({' OR '.join(f'coalesce({f} <> o_{f}, false)' for f in FIELDS)}) AS corrected,
 round((({_S}) / ({_N}) + ({_N}) / 5.0) / 2, 9) AS quality, (({_S}) / ({_N}) + ({_N}) / 5.0) / 2 >= 0.3 AS keep FROM c"""


@query("j6_rule_application", CLEAN_SQL, ["v_contacts"])
def j6(t):
    out = O.clean(t.contacts(), FIELDS)
    return out.select(
        "data_id", *FIELDS, *[F.round(F.col("field_scores")[f], 9).alias(f"score_{f}") for f in FIELDS],
        "corrected", F.round("quality", 9).alias("quality"), "keep")


@query("j7_type_validity", f"SELECT data_id, round(({' + '.join(f'({f} IS NOT NULL)::INT' for f in FIELDS)}) / 5.0, 9)::DOUBLE AS valid_share FROM v_contacts", ["v_contacts"])
def j7(t):
    content = F.create_map(*[x for f in FIELDS for x in (F.lit(f), F.col(f))])
    df = t.contacts().select("data_id", content.alias("content"))
    return df.select("data_id", F.round(type_validity("content"), 9).alias("valid_share"))


def type_validity(content):
    values = F.map_values(content)
    return F.when(F.size(values) == 0, 0.0).otherwise(
        F.size(F.filter(values, lambda v: v.isNotNull())) / F.nullif(F.size(values), F.lit(0)))


@query("j8_record_quality", f"SELECT data_id, quality, keep FROM ({CLEAN_SQL})".replace("FROM (\nWITH", "FROM (WITH"), ["v_contacts"])
def j8(t):
    return O.clean(t.contacts(), FIELDS).select("data_id", F.round("quality", 9).alias("quality"), "keep")


@query("x9_clean_text", f"SELECT doc_id AS data_id, {text_value('text')} AS text FROM documents")
def x9(t):
    return t.texts().select(F.col("doc_id").alias("data_id"), C.squeeze("text").alias("text"))


@query("d11_quality_gate", f"SELECT count(*) FILTER (WHERE keep) AS kept, count(*) FILTER (WHERE NOT keep) AS rejected FROM ({CLEAN_SQL})".replace("FROM (\nWITH", "FROM (WITH"), ["v_contacts"])
def d11(t):
    return O.clean(t.contacts(), FIELDS).agg(F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("rejected"))


@query("j9_content_hash", "SELECT data_id, md5(concat('text=', to_json([text]), chr(10), 'title=', to_json([title]))) AS h FROM v_scraped_data", ["v_scraped_data"])
def j9(t):
    return t.records().select("data_id", C.content_hash(title=F.col("title"), text=F.col("text")).alias("h"))


@query("j9_map_hash", """SELECT data_id, md5(concat('{"content_type":', to_json(content_type), ',"title":', to_json(title), '}')) AS h FROM v_scraped_data""", ["v_scraped_data"])
def j9b(t):
    nested = F.create_map(F.lit("title"), F.col("title"), F.lit("content_type"), F.col("content_type"))
    return t.records().select("data_id", C.map_hash(nested).alias("h"))


@query("g1_keep_first", """
SELECT data_id, job_id FROM (SELECT *, row_number() OVER (PARTITION BY title, text ORDER BY extracted_at, data_id) AS rn FROM v_scraped_data) WHERE rn = 1""", ["v_scraped_data"])
def g1(t):
    return O.keep_first(t.records(), ["title", "text"], ["extracted_at", "data_id"]).select("data_id", "job_id")


@query("g1_later_copies", """
SELECT data_id FROM (SELECT *, row_number() OVER (PARTITION BY title, text ORDER BY extracted_at, data_id) AS rn FROM v_scraped_data) WHERE rn > 1""", ["v_scraped_data"])
def g1b(t):
    return O.split_duplicates(t.records(), ["title", "text"], ["extracted_at", "data_id"]).where("duplicate").select("data_id")


RUN_SQL = f"""
WITH d AS (SELECT *, row_number() OVER (PARTITION BY title, text ORDER BY extracted_at, data_id) > 1 AS dup,
  {text_score('title')} AS st, {text_score('text')} AS sx, least({text_score('url')}, {url_score('url')}) AS su,
  ({text_value('title')} <> title OR {text_value('text')} <> text OR {url_value('url')} <> url) AS corrected,
  (err_a IS NOT NULL)::INT + (err_b IS NOT NULL)::INT AS errs FROM v_scraped_data),
q AS (SELECT *, ((st + sx + su) / 3 + 1) / 2 >= 0.3 AS keep FROM d),
m AS (SELECT count(*) AS total_records, count(*) FILTER (WHERE NOT dup AND keep) AS valid_records, count(*) FILTER (WHERE NOT dup AND NOT keep) AS invalid_records,
  count(*) FILTER (WHERE dup) AS duplicate_records, count(*) FILTER (WHERE NOT dup AND keep AND corrected) AS corrected_records,
  count(*) FILTER (WHERE NOT dup AND keep)::DOUBLE / count(*) AS completeness_score,
  greatest(0.0, 1 - sum(errs) FILTER (WHERE NOT dup AND keep) / (5.0::DOUBLE * count(*) FILTER (WHERE NOT dup AND keep))) AS accuracy_score,
  (avg(st) FILTER (WHERE NOT dup AND keep) + avg(sx) FILTER (WHERE NOT dup AND keep) + avg(su) FILTER (WHERE NOT dup AND keep)) / 3 AS consistency_score FROM q)
"""
RUN_COLS = """total_records, valid_records, invalid_records, duplicate_records, corrected_records, round(completeness_score, 6) AS completeness_score,
 round(accuracy_score, 6) AS accuracy_score, round(consistency_score, 6) AS consistency_score,
 round(completeness_score * 0.4 + accuracy_score * 0.4 + consistency_score * 0.2, 6) AS overall_quality_score"""


def _run(t):
    marked = O.split_duplicates(t.records_with_errors(), ["title", "text"], ["extracted_at", "data_id"])
    return O.cleaning_metrics(O.clean(marked, ["title", "text", "url"]), F.col("duplicate"), ["title", "text", "url"])


SCORES = ["completeness_score", "accuracy_score", "consistency_score", "overall_quality_score"]


@query("f4_cleaning_metrics", RUN_SQL + f"SELECT {RUN_COLS} FROM m", ["v_scraped_data"])
def f4(t):
    return _run(t).withColumns({s: F.round(s, 6) for s in SCORES})


@query("f5_quality_report", RUN_SQL + """
SELECT total_records, concat_ws('; ',
 CASE WHEN completeness_score < 0.8 THEN 'Consider improving data extraction rules to capture more complete records' END,
 CASE WHEN accuracy_score < 0.7 THEN 'Review validation rules and consider additional data cleaning steps' END,
 CASE WHEN consistency_score < 0.6 THEN 'Implement more standardized data extraction patterns' END,
 CASE WHEN duplicate_records > total_records * 0.1 THEN 'Implement stronger duplicate detection during scraping' END,
 CASE WHEN completeness_score * 0.4 + accuracy_score * 0.4 + consistency_score * 0.2 < 0.7 THEN 'Consider manual review of cleaning rules and extraction logic' END) AS recommendations FROM m""", ["v_scraped_data"])
def f5(t):
    return O.quality_report(_run(t)).select("total_records", F.array_join("recommendations", "; ").alias("recommendations"))


@query("m1_custom_rule", """
SELECT data_id, upper(email) AS email FROM v_contacts""", ["v_contacts"])
def m1(t):
    C.register_rule("shout", lambda text, options: C.scored(F.upper(text), F.lit(1.0)))
    out = O.clean(t.contacts().select("data_id", "email"), ["email"], [O.CleaningRule("email", "shout")])
    return out.select("data_id", "email")
