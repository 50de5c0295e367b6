"""Text analysis queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.functions import text as X
from webloom.plans.registry import query

WORDS = "list_filter(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{3,}}'))"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"\b(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b"

ENTITY_SQL = f"""
WITH s AS (SELECT doc_id AS data_id, concat(text, ' see ', 'https://', source, '.example.com/', lang, '/', CAST(doc_id AS STRING)) AS body FROM documents),
e AS (SELECT data_id, 'EMAIL' AS type, unnest(list_distinct(regexp_extract_all(body, '{EMAIL}'))) AS value, 0.9::DOUBLE AS confidence FROM s
UNION ALL SELECT data_id, 'PHONE', unnest(list_distinct(regexp_extract_all(body, '{PHONE}'))), 0.8 FROM s
UNION ALL SELECT data_id, 'URL', unnest(list_distinct(regexp_extract_all(body, 'https?://[!$-_a-z]+'))), 0.9 FROM s)
"""


def bodies(t):
    d = t.texts()
    return d.select(F.col("doc_id").alias("data_id"), F.concat(
        "text", F.lit(" see https://"), "source", F.lit(".example.com/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("body"))


@query("j14_regex_entities", ENTITY_SQL + "SELECT * FROM e")
def j14(t):
    return X.entity_rows(bodies(t), "data_id", "body")


@query("i1_entity_union", ENTITY_SQL + "SELECT type, count(*) AS entities, count(DISTINCT data_id) AS records FROM e GROUP BY type")
def i1(t):
    rows = X.entity_rows(bodies(t), "data_id", "body")
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("entities"), F.countDistinct("data_id").alias("records"))


def _score(words):
    return "(" + " + ".join(f"contains(lower(text), '{w}')::INT" for w in words) + f") / {len(words)}.0::DOUBLE"


CLASSIFY_SQL = "WITH s AS (SELECT doc_id AS data_id, text, " + ", ".join(f"{_score(w)} AS s_{n}" for n, w in X.CATEGORIES.items()) + """ FROM documents),
u AS (SELECT data_id, unnest([""" + ", ".join(f"{{'n': '{n}', 's': s_{n}, 'o': {i}}}" for i, n in enumerate(X.CATEGORIES)) + """]) AS x FROM s),
r AS (SELECT data_id, x.n AS n, x.s AS s, row_number() OVER (PARTITION BY data_id ORDER BY x.s DESC, x.o) AS rn,
  string_agg(CASE WHEN x.s > 0.2 THEN x.n END, ',' ORDER BY x.o) OVER (PARTITION BY data_id) AS subs FROM u)
SELECT data_id, n AS primary_category, round(least(s, 0.8), 9) AS confidence, coalesce(subs, '') AS subcategories FROM r WHERE rn = 1"""


@query("j15_keyword_category", CLASSIFY_SQL)
def j15(t):
    df = t.texts().select(F.col("doc_id").alias("data_id"), X.classify("text").alias("c"))
    return df.select("data_id", "c.primary_category", F.round("c.confidence", 9).alias("confidence"), F.array_join("c.subcategories", ",").alias("subcategories"))


@query("f30_word_frequency", f"SELECT word, count(*) AS uses FROM (SELECT unnest({WORDS.format(t='text')}) AS word FROM documents) GROUP BY word ORDER BY uses DESC, word LIMIT 10")
def f30(t):
    return X.word_frequency(t.texts(), "text", 10)


@query("g4_top_topics", f"""
WITH w AS (SELECT doc_id, {WORDS.format(t='text')} AS ws FROM documents), c AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS topic FROM w),
g AS (SELECT doc_id, n, topic, count(*) AS uses FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY uses DESC, topic) AS rank FROM g)
SELECT doc_id AS data_id, CAST(rank AS INT) AS rank, topic, uses, round(uses::DOUBLE / n, 9) AS relevance FROM r WHERE rank <= 5""")
def g4(t):
    df = t.texts().select(F.col("doc_id").alias("data_id"), "text")
    return X.topics(df, "data_id", "text", 5).withColumn("relevance", F.round("relevance", 9))


@query("j16_text_analysis", f"""
SELECT doc_id AS data_id, CAST(len(list_distinct(regexp_extract_all(text, '{EMAIL}'))) + len(list_distinct(regexp_extract_all(text, '{PHONE}')))
  + len(list_distinct(regexp_extract_all(text, 'https?://[!$-_a-z]+'))) AS INT) AS entities, 'neutral' AS sentiment,
 CASE WHEN length(text) > 200 THEN concat(substr(text, 1, 200), '...') ELSE text END AS summary, 'en' AS language,
 CAST(len({WORDS.format(t='text')}) AS INT) AS word_count FROM documents""")
def j16(t):
    df = X.analyse(t.texts().select(F.col("doc_id").alias("data_id"), "text"), "data_id", "text")
    return df.select("data_id", F.size("entities").alias("entities"), F.col("sentiment.overall").alias("sentiment"), "summary", "language", "word_count")


WS = r"[\s\x0b\x{85}\p{Z}]"
KV = r"([A-Za-z\s\x0b\x{85}\p{Z}]+):[\s\x0b\x{85}\p{Z}]*([^\n]+)"
B = r"(?:^|[^\p{L}\p{N}_])"


@query("j17_header_lines", f"""
WITH l AS (SELECT doc_id AS data_id, regexp_replace(regexp_replace(x, '^{WS}+', ''), '{WS}+$', '') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents))
SELECT data_id, line FROM l WHERE line <> '' AND ((regexp_matches(line, '\\p{{Lu}}') AND NOT regexp_matches(line, '\\p{{Ll}}')) OR line LIKE '%:' OR len(regexp_split_to_array(line, '{WS}+')) <= 5)""")
def j17(t):
    return t.texts().select(F.col("doc_id").alias("data_id"), F.explode(X.header_lines("text")).alias("line"))


@query("j17_key_values", f"""
WITH k AS (SELECT doc_id AS data_id, unnest(regexp_extract_all(body, '{KV}', 1)) AS k, unnest(regexp_extract_all(body, '{KV}', 2)) AS v
 FROM (SELECT doc_id, concat('Source: ', source, chr(10), ' Lang :', lang, '!', chr(10), text) AS body FROM documents))
SELECT data_id, regexp_replace(regexp_replace(k, '^{WS}+', ''), '{WS}+$', '') AS key, regexp_replace(regexp_replace(v, '^{WS}+', ''), '{WS}+$', '') AS value FROM k""")
def j17b(t):
    body = F.concat(F.lit("Source: "), "source", F.lit("\n Lang :"), "lang", F.lit("!\n"), "text")
    return t.texts().select(F.col("doc_id").alias("data_id"), F.explode(X.key_values(body)).alias("p")).select("data_id", "p.key", "p.value")


@query("j17_dates", r"""
WITH s AS (SELECT o_orderkey AS data_id, concat('Ordered ', strftime(o_orderdate, '%d/%m/%Y'), ', due ', strftime(o_orderdate, '%Y-%m-%d'), '; printed ', strftime(o_orderdate, '%B %d, %Y'), ' as no. ', CAST(o_orderkey AS STRING)) AS body FROM orders)
SELECT data_id, unnest(list_concat(regexp_extract_all(body, '(?i)\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b'), list_concat(regexp_extract_all(body, '(?i)\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b'),
 regexp_extract_all(body, '(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}\b')))) AS raw_text FROM s""")
def j17c(t):
    day = F.col("o_orderdate")
    body = F.concat(
        F.lit("Ordered "), F.date_format(day, "dd/MM/yyyy"), F.lit(", due "), F.date_format(day, "yyyy-MM-dd"), F.lit("; printed "),
        F.date_format(day, "MMMM dd, yyyy"), F.lit(" as no. "), F.col("o_orderkey").cast("string"))
    return t["orders"].select(F.col("o_orderkey").alias("data_id"), F.explode(X.dates(body)).alias("raw_text"))


ANSWERS = """
WITH s AS (SELECT doc_id AS data_id, doc_id % 6 AS k, doc_id, source, lang FROM documents),
a AS (SELECT data_id, k, CASE k WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN concat('not json ', source)
 WHEN 3 THEN concat('{"summary":"', source, '","quality_score":', CAST(doc_id % 3 AS STRING), '.5,"topics":["a","b","c","d","e","f","g"],"language":"', lang, '"}')
 WHEN 4 THEN concat('{"summary":"', lang, '","confidence":-0.5,"readability_score":0.25,"content_category":"news"}') ELSE '{"summary":' END AS response, k <> 5 OR doc_id % 4 <> 0 AS enabled, source, lang, doc_id FROM s)
"""


@query("j18_standard_answer", ANSWERS + """
SELECT data_id,
 CASE WHEN NOT enabled THEN 0.0 WHEN k = 0 THEN 0.2 WHEN k = 1 THEN 0.3 WHEN k = 2 OR k = 5 THEN 0.6 WHEN k = 3 THEN least(1.0, doc_id % 3 + 0.5) ELSE 0.0 END::DOUBLE AS confidence,
 CASE WHEN NOT enabled THEN 0.5 WHEN k = 0 THEN 0.2 WHEN k = 1 THEN 0.3 WHEN k = 2 OR k = 5 THEN 0.6 WHEN k = 3 THEN least(1.0, doc_id % 3 + 0.5) ELSE 0.5 END::DOUBLE AS quality_score,
 CASE WHEN enabled AND k = 3 THEN 'a,b,c,d,e' ELSE '' END AS topics, CASE WHEN enabled AND k = 4 THEN 'news' ELSE 'other' END AS content_category,
 CASE WHEN enabled AND k = 3 THEN lang ELSE 'unknown' END AS language,
 CASE WHEN NOT enabled THEN 'disabled' WHEN k = 0 THEN 'error' WHEN k = 1 THEN 'empty_response' WHEN k = 2 OR k = 5 THEN 'partial_success' ELSE 'success' END AS processing_status FROM a""")
def j18(t):
    k, key = F.col("doc_id") % 6, F.col("doc_id")
    response = (
        F.when(k == 1, "  ").when(k == 2, F.concat(F.lit("not json "), "source"))
        .when(k == 3, F.concat(F.lit('{"summary":"'), "source", F.lit('","quality_score":'), (key % 3).cast("string"),
                               F.lit('.5,"topics":["a","b","c","d","e","f","g"],"language":"'), "lang", F.lit('"}')))
        .when(k == 4, F.concat(F.lit('{"summary":"'), "lang", F.lit('","confidence":-0.5,"readability_score":0.25,"content_category":"news"}')))
        .when(k == 5, '{"summary":'))
    df = t.texts().select(key.alias("data_id"), response.alias("response"), ((k != 5) | (key % 4 != 0)).alias("enabled"))
    out = df.select("data_id", X.standard_answer("response", F.col("enabled")).alias("a"))
    return out.select("data_id", "a.confidence", "a.quality_score", F.array_join("a.topics", ",").alias("topics"), "a.content_category", "a.language", "a.processing_status")


@query("j24_looks_like", r"""
SELECT doc_id AS data_id, (regexp_matches(text, '\d{4}-\d{2}-\d{2}') OR regexp_matches(text, '\d{2}/\d{2}/\d{4}') OR regexp_matches(text, '\d{2}-\d{2}-\d{4}') OR regexp_matches(text, '[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4}')) AS date_like,
 regexp_matches(text, '\d') AS price_like FROM documents""")
def j24(t):
    return t.texts().select(F.col("doc_id").alias("data_id"), X.looks_like_date("text").alias("date_like"), X.looks_like_price("text").alias("price_like"))
