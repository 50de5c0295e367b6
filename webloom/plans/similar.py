"""Similarity and confidence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.functions import score as S
from webloom.functions.text import classify, entities
from webloom.operators import similar as M
from webloom.plans.registry import query
from webloom.plans.text import EMAIL, PHONE

WS = r"[\s\x0b\x{85}\p{Z}]"


def toks(c):
    return f"list_distinct(list_filter(regexp_split_to_array(lower({c}), '{WS}+'), lambda w: w <> ''))"


def sim(a, b, ta, tb):
    return (f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN len({ta}) + len({tb}) = 0 THEN 0.0 ELSE "
            f"len(list_intersect({ta}, {tb}))::DOUBLE / (len({ta}) + len({tb}) - len(list_intersect({ta}, {tb}))) END")


@query("e5_similar_records", f"""
WITH c AS (SELECT title, text, min(data_id) AS id FROM v_scraped_data GROUP BY title, text),
k AS MATERIALIZED (SELECT id, title, text, {toks('title')} AS tt, {toks('text')} AS tx FROM c),
p AS (SELECT a.id AS id1, b.id AS id2, {sim('a.title', 'b.title', 'a.tt', 'b.tt')} AS st, a.tx AS x, b.tx AS y, a.text AS vx, b.text AS vy FROM k a JOIN k b ON a.id < b.id AND least(len(a.tx), len(b.tx)) >= 0.69 * greatest(len(a.tx), len(b.tx))),
n AS (SELECT id1, id2, (st + {sim('vx', 'vy', 'x', 'y')}) / 2 AS score FROM p WHERE st >= 0.69)
SELECT id1, id2, round(score, 6) AS score FROM n WHERE score >= 0.85
UNION ALL SELECT c.id, r.data_id, 1.0 FROM v_scraped_data r JOIN c ON c.title = r.title AND c.text = r.text WHERE r.data_id <> c.id""", ["v_scraped_data"])
def e5(t):
    return M.similar_pairs(t.records(), ["title", "text"], 0.85).withColumn("score", F.round("score", 6))


BANDS, ROWS = M.tune_bands(2 * 0.85 - 1, 0.95)


def _bands_sql():
    least = [f"list_min(list_transform(w, lambda h: (h * {a} + {b}) % {M.HASH_PRIME}))" for a, b in M.hash_factors(BANDS * ROWS)]
    return "[" + ", ".join(f"concat_ws('|', '{b}', {', '.join(least[b * ROWS:(b + 1) * ROWS])})" for b in range(BANDS)) + "]"


@query("e5_similar_links", f"""
WITH c AS (SELECT title, text, min(data_id) AS id FROM v_scraped_data GROUP BY title, text),
k AS MATERIALIZED (SELECT id, title, text, {toks('title')} AS tt, {toks('text')} AS tx FROM c),
h AS MATERIALIZED (SELECT id, list_transform(list_concat(list_transform(tt, lambda x: concat('0:', x)), list_transform(tx, lambda x: concat('1:', x))), lambda x: CAST(concat('0x', substr(md5(x), 1, 7)) AS BIGINT)) AS w FROM k),
o1 AS MATERIALIZED (SELECT id AS id2, unnest({_bands_sql()}) AS band FROM h WHERE len(w) > 0),
m1 AS MATERIALIZED (SELECT o.band, o.id2, f.id1 FROM o1 o JOIN (SELECT band, min(id2) AS id1 FROM o1 GROUP BY band) f ON f.band = o.band WHERE f.id1 < o.id2),
s1 AS MATERIALIZED (SELECT id1, id2, ({sim('a.title', 'b.title', 'a.tt', 'b.tt')} + {sim('a.text', 'b.text', 'a.tx', 'b.tx')}) / 2 AS score FROM (SELECT DISTINCT id1, id2 FROM m1) p JOIN k a ON a.id = id1 JOIN k b ON b.id = id2),
o2 AS MATERIALIZED (SELECT m1.band, m1.id2 FROM m1 JOIN s1 ON m1.id1 = s1.id1 AND m1.id2 = s1.id2 WHERE s1.score < 0.85),
m2 AS MATERIALIZED (SELECT o.band, o.id2, f.id1 FROM o2 o JOIN (SELECT band, min(id2) AS id1 FROM o2 GROUP BY band) f ON f.band = o.band WHERE f.id1 < o.id2),
s2 AS MATERIALIZED (SELECT id1, id2, ({sim('a.title', 'b.title', 'a.tt', 'b.tt')} + {sim('a.text', 'b.text', 'a.tx', 'b.tx')}) / 2 AS score FROM (SELECT DISTINCT id1, id2 FROM m2) p JOIN k a ON a.id = id1 JOIN k b ON b.id = id2)
SELECT id1, id2, round(score, 6) AS score FROM (SELECT * FROM s1 UNION SELECT * FROM s2) WHERE score >= 0.85
UNION ALL SELECT c.id, r.data_id, 1.0 FROM v_scraped_data r JOIN c ON c.title = r.title AND c.text = r.text WHERE r.data_id <> c.id""", ["v_scraped_data"])
def e5b(t):
    """Approximate mode: one link per similar record and band instead of all pairs."""
    return M.similar_links(t.records(), ["title", "text"], 0.85).withColumn("score", F.round("score", 6))


NEXT = f"""WITH d AS (SELECT doc_id, text, source, {toks('text')} AS tk, {toks('source')} AS ts FROM documents)"""


def neighbours(t):
    d = t.texts().select("doc_id", F.struct("text", "source").alias("a"))
    other = t.texts().select((F.col("doc_id") - 1).alias("doc_id"), F.struct("text", "source").alias("b"))
    return d.join(other, "doc_id")


@query("j13_content_similarity", NEXT + f"""
SELECT a.doc_id, round(({sim('a.text', 'b.text', 'a.tk', 'b.tk')} + {sim('a.source', 'b.source', 'a.ts', 'b.ts')}) / 2, 6) AS similarity FROM d a JOIN d b ON b.doc_id = a.doc_id + 1""")
def j13(t):
    return neighbours(t).select("doc_id", F.round(M.content_similarity(["text", "source"]), 6).alias("similarity"))


@query("i5_token_sets", NEXT + """
SELECT a.doc_id, CAST(len(list_intersect(a.tk, b.tk)) AS INT) AS shared, CAST(len(list_distinct(list_concat(a.tk, b.tk))) AS INT) AS every FROM d a JOIN d b ON b.doc_id = a.doc_id + 1""")
def i5(t):
    n = neighbours(t).select("doc_id", M.tokens(F.col("a.text")).alias("x"), M.tokens(F.col("b.text")).alias("y"))
    return n.select("doc_id", M.overlap(F.col("x"), F.col("y")).alias("shared"), F.size(F.array_union("x", "y")).alias("every"))


def st(c):
    return f"regexp_replace(regexp_replace({c}, '^{WS}+', ''), '{WS}+$', '')"


def _conf(x):
    return f"regexp_full_match({x}, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}')"


# data: title, text, parts list<string> (source, lang, source), link_url, item_count, date_seen, price
CONF_SQL = f"""
WITH d AS (SELECT doc_id AS data_id, split_part(text, '.', 1) AS title, text, source, lang, CASE WHEN doc_id % 3 = 0 THEN [source, lang, source] ELSE [] END AS parts,
  CASE WHEN doc_id % 4 = 0 THEN 'n/a' ELSE concat('https://x.org/', CAST(doc_id AS STRING)) END AS link_url, n_chars, CASE WHEN doc_id % 2 = 0 THEN '2024-01-31' ELSE 'soon' END AS date_seen,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE '$5' END AS price,
  list_distinct(regexp_extract_all(text, '{EMAIL}')) AS em, list_distinct(regexp_extract_all(text, '{PHONE}')) AS ph, list_distinct(regexp_extract_all(text, 'https?://[!$-_a-z]+')) AS ur FROM documents),
e AS (SELECT *, len(em) AS ne, len(ph) AS np, len(ur) AS nu, len(em) + len(ph) + len(ur) AS n, length(text) AS len, length({st('text')}) AS slen FROM d),
f AS (SELECT *, (ne * 0.9 + np * 0.8 + nu * 0.9) AS cs, (ne * 0.81 + np * 0.64 + nu * 0.81) AS cq,
  (({st('title')} <> '')::INT + ({st('text')} <> '')::INT + (len(parts) > 0)::INT + 1 + 0 + 1 + (price IS NOT NULL)::INT) / 7.0::DOUBLE AS filled,
  least(n / greatest(least(len // 500, 20), 1)::DOUBLE, 1.0) AS cover,
  1 - ((doc_ok = 0)::INT + (price IS NULL)::INT) / 7.0::DOUBLE AS tc,
  ((title <> '')::INT + (text <> '')::INT + (len(parts) > 0)::INT + 1 + (n_chars <> 0)::INT + 1 + (price IS NOT NULL)::INT) AS used,
  ((title <> '')::INT + (text <> '')::INT + 1 + (link_url <> 'n/a')::INT + 1 + 1 + (price IS NOT NULL)::INT) / 7.0::DOUBLE AS fit,
  CASE WHEN len(parts) > 0 THEN 2 ELSE 1 END AS dp,
  least((length(title) + len + coalesce(len(list_aggregate(parts, 'string_agg', '')), 0) + length(link_url) + length(date_seen) + coalesce(length(price), 0)) / nullif(slen, 0)::DOUBLE, 1.0) AS er,
  list_transform(list_filter(list_concat([title, text], list_concat(parts, [link_url, date_seen, price])), lambda x: length({st('x')}) > 3), lambda x: lower({st('x')})) AS tv
 FROM (SELECT *, (date_seen = '2024-01-31')::INT AS doc_ok FROM e)),
g AS (SELECT data_id, n,
  (filled + CASE WHEN len > 0 THEN cover ELSE 0 END + 0.4) / (2 + (len > 0)::INT) AS completeness,
  (CASE WHEN n > 0 THEN greatest(0, 1 - (cq / nullif(n, 0) - power(cs / nullif(n, 0), 2))) ELSE 0 END + cls + tc) / (2 + (n > 0)::INT) AS consistency,
  CASE WHEN n > 0 THEN cq / cs ELSE 0 END AS entity_confidence,
  (greatest(0, 1 - abs(dp - 3) / 5.0::DOUBLE) + used / 7.0::DOUBLE + fit) / 3 AS structure_quality,
  (CASE WHEN slen > 0 THEN greatest(0, CASE WHEN er < 0.3 THEN er / 0.3 WHEN er <= 0.8 THEN 1 ELSE 1 - (er - 0.8) / 0.2 END) ELSE 0 END
   + CASE WHEN n > 0 THEN ((ne > 0)::INT + (np > 0)::INT + (nu > 0)::INT) / 5.0::DOUBLE ELSE 0 END + least(used / 8.0::DOUBLE, 1)) / (1 + (slen > 0)::INT + (n > 0)::INT) AS content_richness,
  (CASE WHEN ne > 0 THEN len(list_filter(em, lambda x: {_conf('x')}))::DOUBLE / ne ELSE 0 END + CASE WHEN nu > 0 THEN len(list_filter(ur, lambda x: contains(x, '.')))::DOUBLE / nu ELSE 0 END
   + CASE WHEN np > 0 THEN len(list_filter(ph, lambda x: length(regexp_replace(x, '[^0-9+]', '', 'g')) BETWEEN 7 AND 15))::DOUBLE / np ELSE 0 END
   + CASE WHEN len(tv) > 0 AND 1 - len(list_distinct(tv))::DOUBLE / len(tv) > 0.5 THEN 0.7 ELSE 1 END) / (1 + (ne > 0)::INT + (nu > 0)::INT + (np > 0)::INT) AS validation_score
 FROM f JOIN cl USING (data_id))
SELECT data_id, {{cols}} FROM g"""


def _conf_sql(cols):
    from webloom.functions.text import CATEGORIES

    def share(words):
        return "(" + " + ".join(f"contains(lower(text), '{w}')::INT" for w in words) + f") / {len(words)}.0::DOUBLE"

    cl = "cl AS (SELECT doc_id AS data_id, least(0.8, greatest(" + ", ".join(share(w) for w in CATEGORIES.values()) + ")) AS cls FROM documents),\nd AS ("
    return CONF_SQL.replace("WITH d AS (", "WITH " + cl, 1).replace("{cols}", cols)


PARTS = list(S.WEIGHTS)
WHOLE = " + ".join(f"{p} * {w}" for p, w in S.WEIGHTS.items())


def _breakdown(t):
    key = F.col("doc_id")
    d = t.texts().select(
        key.alias("data_id"), "text", F.struct(
            F.split_part("text", F.lit("."), F.lit(1)).alias("title"), "text",
            F.when(key % 3 == 0, F.array("source", "lang", "source")).otherwise(F.array().cast("array<string>")).alias("parts"),
            F.when(key % 4 == 0, "n/a").otherwise(F.concat(F.lit("https://x.org/"), key.cast("string"))).alias("link_url"),
            F.col("n_chars").alias("item_count"), F.when(key % 2 == 0, "2024-01-31").otherwise("soon").alias("date_seen"),
            F.when(key % 5 != 0, "$5").alias("price")).alias("data"),
        entities("text").alias("found"), classify("text")["confidence"].alias("cls"))
    return S.confidence_breakdown(d, "data", "found", F.col("cls"), "text")


@query("j19_confidence", _conf_sql(f"round(least(1.0, greatest(0.0, {WHOLE})), 6)::DOUBLE AS confidence"))
def j19(t):
    return _breakdown(t).select("data_id", F.round("confidence", 6).alias("confidence"))


ORDERED = {"completeness": "a", "consistency": "b", "entity_confidence": "c", "structure_quality": "d", "content_richness": "e", "validation_score": "f"}


def _register(part, letter):
    @query(f"j19{letter}_{part}", _conf_sql(f"round({part}, 6)::DOUBLE AS {part}"))
    def one(t):
        return _breakdown(t).select("data_id", F.round(part, 6).alias(part))


for _part, _letter in ORDERED.items():
    _register(_part, _letter)
