"""Validation, coercion, protection and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.functions import protect as P
from webloom.functions import urls as U
from webloom.functions import validate as V
from webloom.operators import audit as A
from webloom.plans.cleaning import strip_sql
from webloom.plans.registry import query

B0, B1 = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def _danger_sql(c):
    """First hit of the list, with Unicode word edges spelled out."""
    parts = []
    for p in V.DANGEROUS:
        flat = p.replace("'", "''").replace(r"\w", r"[\p{L}\p{N}_]").replace(r"\s", r"[\s\x{85}\p{Z}]")
        if flat.startswith(r"(\b(") and flat.endswith(r")\b)"):
            parts.append(f"nullif(regexp_extract({c}, '(?im){B0}{flat[3:-3]}{B1}', 1), '')")
        elif flat.startswith(r"\b(") and flat.endswith(r")\b"):
            parts.append(f"nullif(regexp_extract({c}, '(?im){B0}{flat[2:-2]}{B1}', 1), '')")
        elif flat.startswith(r"(\bor") or flat.startswith(r"(\band"):
            word = "or" if "or" in flat[:6] else "and"
            parts.append(f"nullif(regexp_extract({c}, '(?im){B0}({word}[\\s\\x{{85}}\\p{{Z}}]+[0-9]+[\\s\\x{{85}}\\p{{Z}}]*=[\\s\\x{{85}}\\p{{Z}}]*[0-9]+)', 1), '')")
        else:
            parts.append(f"nullif(regexp_extract({c}, '(?im){flat}'), '')")
    return "coalesce(" + ", ".join(parts) + ")"


@query("j23_dangerous_match", f"SELECT doc_id AS data_id, {_danger_sql('text')} AS found FROM documents")
def j23(t):
    return t.texts().select(F.col("doc_id").alias("data_id"), V.dangerous_match("text").alias("found"))


SUSPICIOUS_SQL = " OR ".join(
    "regexp_matches(raw_html, '(?i)" + p.replace(r"\w", r"[\p{L}\p{N}_]").replace(r"\s", r"[\s\x{85}\p{Z}]") + "')" for p in V.SUSPICIOUS)


@query("j23_suspicious_page", f"SELECT page_id, ({SUSPICIOUS_SQL}) AS suspicious FROM v_pages", ["v_pages"])
def j23b(t):
    return t.pages().select("page_id", V.is_suspicious("raw_html").alias("suspicious"))


@query("j20_url_levels", f"""
SELECT data_id, coalesce(url LIKE 'http://%' OR url LIKE 'https://%', false) AS web_prefix,
 coalesce(regexp_full_match(url, '(?i)https?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{{0,61}}[A-Z0-9])?\\.)+[A-Z]{{2,6}}\\.?|localhost|\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}})(?::\\d+)?(?:/?|[/?]\\S+)'), false) AS job_url,
 CASE WHEN trim(url) LIKE 'http%://%' THEN trim(url) WHEN trim(url) LIKE '//%' THEN concat('https:', trim(url)) ELSE concat('https://', trim(url)) END AS web_url
FROM (SELECT data_id, url FROM v_contacts UNION ALL SELECT data_id, url FROM v_scraped_data)""", ["v_contacts", "v_scraped_data"])
def j20(t):
    both = t.contacts().select("data_id", "url").unionByName(t.records().select("data_id", "url"))
    return both.select("data_id", U.has_web_prefix("url").alias("web_prefix"), U.is_job_url("url").alias("job_url"), U.web_url("url").alias("web_url"))


@query("j20_checked_url", """
WITH s AS (SELECT page_id, concat(regexp_replace(url, '^http', 'HTTP'), '?q=a b+c&x=', CAST(page_id AS STRING), '~*') AS url FROM pages),
d AS (SELECT page_id, concat('ftp://', CAST(page_id AS STRING), '.example.com') AS url FROM pages)
SELECT page_id, false AS is_valid, CAST(NULL AS STRING) AS value, 1 AS errors FROM s
UNION ALL SELECT page_id, false, NULL, 2 FROM d
UNION ALL SELECT page_id, true, concat(regexp_extract(url, '^(https?://[^/?#]*)', 1), '/p%20%C3%A9/', CAST(page_id AS STRING), '?q=a%20b&x=1~%2A'), 0 FROM pages""")
def j20b(t):
    p = t["pages"]
    num = F.col("page_id").cast("string")
    many = p.select("page_id", F.explode(F.array(
        F.concat(F.regexp_replace("url", "^http", "HTTP"), F.lit("?q=a b+c&x="), num, F.lit("~*")),
        F.concat(F.lit("ftp://"), num, F.lit(".example.com")),
        F.concat(F.regexp_extract("url", "^(https?://[^/?#]*)", 1), F.lit("/p é/"), num, F.lit("?q=a b&x=1~*")),
    )).alias("u"))
    # an & in the query is itself on the list of dangerous characters
    out = many.select("page_id", V.check_url(F.replace("u", F.lit("a b&x=1"), F.lit("a b\u0001x=1"))).alias("r"))
    return out.select(
        "page_id", "r.is_valid", F.replace("r.value", F.lit("%01x=1"), F.lit("&x=1")).alias("value"), F.size("r.errors").alias("errors"))


@query("j21_resolve", r"""
WITH r AS (SELECT o_orderkey AS id, o_orderkey % 8 AS k, CAST(o_orderkey AS STRING) AS n FROM orders)
SELECT id, CASE k WHEN 0 THEN concat('http://other.org/', n) WHEN 1 THEN concat('https://cdn.net/', n) WHEN 2 THEN concat('https://Host.example.com/root/', n)
 WHEN 3 THEN concat('https://Host.example.com/a/b/', n, '?x=1#y') WHEN 4 THEN concat('https://Host.example.com/a/b/page.html?p=', n) WHEN 5 THEN concat('https://Host.example.com/a/b/page.html?q=1#', n)
 WHEN 6 THEN concat('https://Host.example.com/a/', n, '/') ELSE 'https://Host.example.com/a/b/page.html?q=1' END AS url,
 k IN (0, 1) AS external FROM r""")
def j21(t):
    k, n = F.col("o_orderkey") % 8, F.col("o_orderkey").cast("string")
    ref = (
        F.when(k == 0, F.concat(F.lit("http://other.org/"), n)).when(k == 1, F.concat(F.lit("//cdn.net/"), n))
        .when(k == 2, F.concat(F.lit("/x/../root/./"), n)).when(k == 3, F.concat(n, F.lit("?x=1#y")))
        .when(k == 4, F.concat(F.lit("?p="), n)).when(k == 5, F.concat(F.lit("#"), n))
        .when(k == 6, F.concat(F.lit("../"), n, F.lit("/x/.."))).otherwise(""))
    base = F.lit("https://Host.example.com/a/b/page.html?q=1")
    df = t["orders"].select(F.col("o_orderkey").alias("id"), U.resolve(base, ref).alias("url"))
    return df.select("id", "url", U.is_external("url", base).alias("external"))


@query("j22_checked_string", f"""
SELECT doc_id AS data_id, length(text) <= 1000 AND {_danger_sql('text')} IS NULL AS is_valid,
 {strip_sql("regexp_replace(replace(replace(replace(replace(replace(substr(text, 1, 1000), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'), '[\\s\\x0b\\x{85}\\p{Z}]+', ' ', 'g')")} AS value,
 CAST((length(text) > 1000)::INT + ({_danger_sql('text')} IS NOT NULL)::INT AS INT) AS errors FROM documents""")
def j22(t):
    df = t.texts().select(F.col("doc_id").alias("data_id"), V.check_string("text").alias("r"))
    return df.select("data_id", "r.is_valid", "r.value", F.size("r.errors").alias("errors"))


E = "lower(" + strip_sql("email") + ")"


@query("j22_checked_email", f"""
SELECT data_id, CASE WHEN {E} = '' THEN true ELSE regexp_full_match({E}, '[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}') AND {_danger_sql(E)} IS NULL END AS is_valid,
 CASE WHEN {E} = '' THEN '' WHEN regexp_full_match({E}, '[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}') AND {_danger_sql(E)} IS NULL THEN {E} END AS value FROM v_contacts""", ["v_contacts"])
def j22b(t):
    return t.contacts().select("data_id", V.check_email("email").alias("r")).select("data_id", "r.is_valid", "r.value")


@query("j22_checked_filename", """
SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN concat('file_CON.', CAST(p_partkey AS STRING)) WHEN 1 THEN concat('a_b_', p_brand, '_x.txt') WHEN 2 THEN concat('__', CAST(p_partkey AS STRING), '.csv') ELSE 'unnamed_file' END AS value FROM part""")
def j22c(t):
    k, n = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    name = (F.when(k == 0, F.concat(F.lit("CON."), n)).when(k == 1, F.concat(F.lit("a/b:"), "p_brand", F.lit("?x.txt")))
            .when(k == 2, F.concat(F.lit(" ../"), n, F.lit(".csv. "))).otherwise(" . . "))
    return t["part"].select(F.col("p_partkey").alias("id"), V.check_filename(name).alias("r")).select("id", "r.value")


@query("j22_checked_uuid", """
SELECT c_custkey AS id, c_custkey % 3 <> 0 AS is_valid, CASE WHEN c_custkey % 3 <> 0 THEN regexp_replace(md5(c_name), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') END AS value FROM customer""")
def j22d(t):
    k, h = F.col("c_custkey") % 3, F.md5("c_name")
    raw = F.when(k == 1, F.upper(h)).when(k == 2, F.concat(F.lit("{"), h, F.lit("}"))).otherwise(F.substring(h, 1, 30))
    return t["customer"].select(F.col("c_custkey").alias("id"), V.check_uuid(raw).alias("r")).select("id", "r.is_valid", "r.value")


def _open_json(t):
    """Documents of all kinds: plain, deep, with many keys, with many items, broken, deeper than the parser goes, with markup, dangerous."""
    n, k = F.col("event_id"), F.col("event_id").cast("string")
    nested = F.concat(F.repeat(F.lit('{"a":['), (n % 7).cast("int")), k, F.repeat(F.lit("]}"), (n % 7).cast("int")))
    keys = F.concat(F.lit('{"o":{'), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(99) + (n % 4).cast("int")), lambda i: F.concat(F.lit('"k'), i, F.lit('":1'))), ","), F.lit("}}"))
    items = F.concat(F.lit("[["), F.array_join(F.array_repeat(F.lit("0"), F.lit(999) + (n % 3).cast("int")), ","), F.lit("],2]"))
    huge = F.concat(F.repeat(F.lit("["), 1500), F.repeat(F.lit("]"), 1500))
    marked = F.concat(F.lit('{"t":"a < b > '), k, F.lit(' \\"q\\"","u":["it\'s",null,true,2.5],"e":{},"l":[]}'))
    doc = (
        F.when(n % 8 == 0, nested).when(n % 8 == 1, keys).when((n % 8 == 2) & (n % 5 == 0), items).when(n % 8 == 3, F.concat(F.lit('{"a":'), k))
        .when((n % 8 == 4) & (n % 25 == 4), huge).when(n % 8 == 5, marked).when(n % 8 == 6, F.concat(F.lit('{"x":["drop '), k, F.lit('"]}'))).otherwise(F.col("props")))
    return t["events"].select("event_id", doc.alias("doc"))


JSON_DOCS = r"""
docs AS (SELECT event_id, CASE WHEN event_id % 8 = 0 THEN concat(repeat('{"a":[', CAST(event_id % 7 AS INT)), CAST(event_id AS STRING), repeat(']}', CAST(event_id % 7 AS INT)))
  WHEN event_id % 8 = 1 THEN concat('{"o":{', array_to_string(list_transform(range(1, 100 + event_id % 4), lambda i: concat('"k', CAST(i AS STRING), '":1')), ','), '}}')
  WHEN event_id % 8 = 2 AND event_id % 5 = 0 THEN concat('[[', array_to_string(list_transform(range(0, 999 + event_id % 3), lambda i: '0'), ','), '],2]')
  WHEN event_id % 8 = 3 THEN concat('{"a":', CAST(event_id AS STRING)) WHEN event_id % 8 = 4 AND event_id % 25 = 4 THEN concat(repeat('[', 1500), repeat(']', 1500))
  WHEN event_id % 8 = 5 THEN concat('{"t":"a < b > ', CAST(event_id AS STRING), ' \"q\"","u":["it''s",null,true,2.5],"e":{},"l":[]}')
  WHEN event_id % 8 = 6 THEN concat('{"x":["drop ', CAST(event_id AS STRING), '"]}') ELSE props END AS doc FROM events),
huge AS (SELECT event_id FROM docs WHERE starts_with(doc, '[[[[[[[[[[[[')),
read AS (SELECT event_id, doc FROM docs WHERE json_valid(doc) AND event_id NOT IN (SELECT event_id FROM huge)),
nodes AS (SELECT d.event_id, j.key, j.type, j.id, j.parent, j.fullkey, j.json, length(regexp_replace(j.fullkey, '[^.\[]', '', 'g')) AS depth, j.atom
  FROM read d, LATERAL (SELECT key, value AS json, type, atom, id, parent, fullkey FROM json_tree(d.doc)) j)"""


@query("j25_json_checks", f"""
WITH {JSON_DOCS},
faults AS (SELECT event_id, bool_or(depth > 10) AS deep, bool_or(type = 'OBJECT' AND len(json_keys(json)) > 100) AS wide, bool_or(type = 'ARRAY' AND json_array_length(json) > 1000) AS long,
  bool_or(type = 'VARCHAR' AND starts_with(atom, '"drop ')) AS danger FROM nodes WHERE depth <= 11 GROUP BY event_id)
SELECT event_id, error IS NULL AS is_valid, error FROM (
  SELECT d.event_id, CASE WHEN h.event_id IS NOT NULL THEN 'exceeds maximum depth of 10' WHEN NOT json_valid(d.doc) THEN 'is not valid JSON' WHEN deep THEN 'exceeds maximum depth of 10'
    WHEN wide THEN 'object has too many keys (max: 100)' WHEN long THEN 'array is too large' WHEN danger THEN 'contains a dangerous pattern' END AS error
  FROM docs d LEFT JOIN huge h USING (event_id) LEFT JOIN faults USING (event_id))""")
def j25(t):
    return V.check_json(_open_json(t), "doc").select("event_id", "is_valid", "error")


@query("j25_json_nodes", f"""
WITH {JSON_DOCS}
SELECT event_id, CAST(depth AS INT) AS depth, CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind,
  count(*) AS nodes, CAST(max(CASE type WHEN 'OBJECT' THEN len(json_keys(json)) WHEN 'ARRAY' THEN json_array_length(json) END) AS INT) AS largest
FROM nodes WHERE depth <= 10 GROUP BY ALL""")
def j25b(t):
    """Nodes per document, depth and kind, with the size of the largest."""
    nodes = V.json_nodes(_open_json(t), "event_id", "doc")
    return nodes.groupBy("event_id", "depth", "kind").agg(F.count(F.lit(1)).alias("nodes"), F.max("size").alias("largest"))


@query("j25_safe_copies", r"""
WITH s AS (SELECT event_id, concat('a < b > ', CAST(event_id AS STRING), ' "q"') AS x FROM events WHERE event_id % 8 = 5),
e AS (SELECT event_id, replace(replace(replace(x, '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS x FROM s)
SELECT event_id, concat('{"e": {}, "l": [], "t": "', x, '", "u": ["it&#x27;s", null, true, 2.5]}') AS value FROM e
UNION ALL SELECT event_id, replace(props, ':', ': ') FROM (SELECT event_id, replace(props, ' ', '') AS props FROM events WHERE event_id % 8 = 7)""")
def j25c(t):
    """Escaped copies of the documents with markup and of plain ones."""
    checked = V.check_json(_open_json(t), "doc").where(F.col("event_id") % 8 >= 5)
    return checked.where("value IS NOT NULL").select("event_id", "value")


@query("j26_json_profile", """
WITH s AS (SELECT event_id, concat('{"props":', props, ',"type":"', event_type, '","value":', CAST(value AS STRING), ',"tags":[1,2,3],"ok":true,"none":null}') AS doc FROM events),
k AS (SELECT event_id, doc, unnest(json_keys(doc)) AS name FROM s)
SELECT event_id, name, CASE json_type(doc, concat('$.', name)) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS type,
 CASE WHEN name = 'tags' THEN CAST(json_array_length(doc, '$.tags') AS INT) END AS items FROM k""")
def j26(t):
    doc = F.concat(F.lit('{"props":'), "props", F.lit(',"type":"'), "event_type", F.lit('","value":'), F.col("value").cast("string"), F.lit(',"tags":[1,2,3],"ok":true,"none":null}'))
    return V.json_profile(t["events"].select("event_id", doc.alias("doc")), "event_id", "doc")


@query("j27_coercion", """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value ELSE 0.0 END AS as_float, coalesce(CASE WHEN event_id % 3 > 0 THEN event_type END, '') AS as_string,
 CASE WHEN event_id % 3 > 0 THEN 1 ELSE 0 END AS list_items, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS map_items, CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) END AS as_time FROM events""")
def j27(t):
    e, even = t["events"], F.col("event_id") % 2 == 0
    raw = F.when(even, F.col("value").cast("string")).otherwise("n/a")
    word = F.when(F.col("event_id") % 3 > 0, F.col("event_type"))
    when = F.when(even, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).otherwise("soon")
    return e.select(
        "event_id", V.ensure_float(raw).alias("as_float"), V.ensure_string(word).alias("as_string"),
        F.size(V.ensure_list(word, False)).alias("list_items"),
        F.size(V.ensure_map(F.when(even, F.create_map(F.lit("k"), F.col("event_type"))))).alias("map_items"), V.ensure_timestamp(when).cast("timestamp_ntz").alias("as_time"))


@query("j31_strip_credentials", """
SELECT data_id, CASE data_id % 4 WHEN 2 THEN concat('https://s', CAST(data_id AS STRING), '.example.com:8080/a?b=1 ') ELSE '[REDACTED]' END AS url FROM v_contacts""", ["v_contacts"])
def j31(t):
    return t.contacts().select("data_id", U.without_credentials(F.ltrim("url")).alias("url"))


@query("i4_conformance", """
SELECT 'known_status' AS rule, count(*) FILTER (WHERE status NOT IN ('pending', 'running', 'completed', 'failed', 'cancelled')) AS violations FROM v_jobs
UNION ALL SELECT 'pages_in_range', count(*) FILTER (WHERE pages_completed > total_pages) FROM v_jobs
UNION ALL SELECT 'started_before_created', count(*) FILTER (WHERE NOT coalesce(started_at >= created_at, false)) FROM v_jobs
UNION ALL SELECT 'priority_range', count(*) FILTER (WHERE NOT priority BETWEEN 1 AND 9) FROM v_jobs""", ["v_jobs"])
def i4(t):
    return V.violations(t.jobs(), {
        "known_status": F.col("status").isin(*V.JOB_STATUSES), "pages_in_range": F.col("pages_completed") <= F.col("total_pages"),
        "started_before_created": F.col("started_at") >= F.col("created_at"), "priority_range": F.col("priority").between(1, 9)})


@query("i4_schema_gaps", """
SELECT 'tags' AS "column", 'missing' AS problem, count(*) AS rows FROM v_jobs
UNION ALL SELECT 'error_message', 'is string, expected int', count(error_message) FROM v_jobs
UNION ALL SELECT 'job_id', 'is bigint, expected string', count(*) FILTER (WHERE false) FROM v_jobs""", ["v_jobs"])
def i4b(t):
    """Expected columns that the job table does not have as expected, with the rows that this spoils."""
    return V.schema_gaps(t.jobs(), {"job_id": "string", "status": "string", "tags": "array<string>", "error_message": "int", "priority": "int"})


# --- protection ----------------------------------------------------------------------------

@query("j10_salted_hash", "SELECT c_custkey AS id, concat(sha256(concat(c_name, 'pepper')), ':pepper') AS hashed, true AS matches, c_name = c_mktsegment AS other FROM customer")
def j10(t):
    df = t["customer"].select(F.col("c_custkey").alias("id"), "c_name", "c_mktsegment", P.salted_hash("c_name", "pepper").alias("hashed"))
    return df.select("id", "hashed", P.hash_matches("c_name", "hashed").alias("matches"), P.hash_matches("c_mktsegment", "hashed").alias("other"))


@query("j12_protect_round_trip", """
SELECT data_id, email AS contact_email, phone AS phone_no, text AS note, email IS NOT NULL AS email_hidden, false AS note_hidden, email AS wrong_key_email_differs FROM (SELECT data_id, coalesce(email, 'x') AS email, phone, text FROM v_contacts)""".replace(", email AS wrong_key_email_differs", ""), ["v_contacts"])
def j12(t):
    key = F.lit("0123456789abcdef")
    content = F.create_map(F.lit("contact_email"), "email", F.lit("phone_no"), "phone", F.lit("note"), "text")
    hidden = t.contacts().select("data_id", P.protect(content, key).alias("c"))
    open_ = P.unprotect("c", key)
    return hidden.select(
        "data_id", *[open_[k].alias(k) for k in ("contact_email", "phone_no", "note")],
        F.col("c")["contact_email"].startswith(P.MARK).alias("email_hidden"), F.col("c")["note"].startswith(P.MARK).alias("note_hidden"))


@query("c9_request_log", """
SELECT event_id, concat('10.0.0.', CAST(user_id AS STRING)) AS client_ip, '[REDACTED]' AS auth_header,
 CASE WHEN length(repeat(concat(event_type, ' '), 20)) > 100 THEN concat(substr(repeat(concat(event_type, ' '), 20), 1, 100), '...') ELSE repeat(concat(event_type, ' '), 20) END AS agent,
 user_id * 10 AS body_size_bytes FROM events""")
def c9(t):
    headers = F.create_map(
        F.lit("authorization"), F.concat(F.lit("Bearer "), F.md5("props")),
        F.lit("user-agent"), F.repeat(F.concat("event_type", F.lit(" ")), F.lit(20)),
        F.lit("x-forwarded-for"), F.concat(F.lit("10.0.0."), F.col("user_id").cast("string"), F.lit(", 172.16.0.1")),
        F.lit("content-length"), (F.col("user_id") * 10).cast("string"))
    df = P.request_log(t["events"].select("event_id", headers.alias("headers"), F.lit("127.0.0.1").alias("peer")))
    h = F.col("headers")
    return df.select("event_id", "client_ip", h["authorization"].alias("auth_header"), h["user-agent"].alias("agent"), "body_size_bytes")


@query("c9_request_target", """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '/' ELSE concat('/api/v1/', event_type) END AS path,
 CASE WHEN event_id % 4 = 1 THEN event_type || ' & more' WHEN event_id % 4 = 2 THEN CAST(user_id AS STRING) END AS q, CASE WHEN event_id % 4 IN (1, 2) THEN '' END AS empty,
 CASE event_id % 4 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN NULL END AS params FROM events""")
def c9b(t):
    """Paths and query parameters: escapes, repeated names, empty values, none at all."""
    kind, base = F.col("event_id") % 4, F.concat(F.lit("https://api.example.com/api/v1/"), "event_type")
    url = F.when(kind == 0, "https://api.example.com").when(kind == 1, F.concat(base, F.lit("?q=first&empty=&q="), "event_type", F.lit("+%26%20more#q=no"))) \
        .when(kind == 2, F.concat(base, F.lit("?empty=&noise&=x&q="), F.col("user_id").cast("string"))).otherwise(base)
    out = P.request_target(t["events"].select("event_id", url.alias("url")))
    q = F.col("query_params")
    return out.select("event_id", "path", q["q"].alias("q"), q["empty"].alias("empty"), F.when(q.isNotNull(), F.size(q)).alias("params"))


@query("c9_response_log", """
SELECT event_id, CASE event_type WHEN 'error' THEN 500 ELSE 200 END AS status_code, round(value / 100 + 0.00005, 3) AS processing_time_seconds, value / 100 > 5 AS is_slow,
 user_id * 10 AS body_size_bytes, '[REDACTED]' AS cookie FROM events""")
def c9c(t):
    headers = F.create_map(F.lit("content-length"), (F.col("user_id") * 10).cast("string"), F.lit("Cookie"), F.md5("props"))
    status = F.when(F.col("event_type") == "error", 500).otherwise(200)
    df = P.response_log(t["events"].select("event_id", status.alias("status_code"), (F.col("value") / 100 + 0.00005).alias("seconds"), headers.alias("headers")))
    return df.select("event_id", "status_code", "processing_time_seconds", "is_slow", "body_size_bytes", F.col("headers")["Cookie"].alias("cookie"))


AUDIT = """
WITH a AS (SELECT event_id, user_id, ts, event_type, value, CASE WHEN event_type IN ('error', 'signup') THEN 'auth' WHEN event_type = 'view' THEN 'data_access' ELSE 'security_alert' END AS kind, event_type <> 'error' AS success FROM events)
"""


def _audit(t):
    kind = F.when(F.col("event_type").isin("error", "signup"), "auth").when(F.col("event_type") == "view", "data_access").otherwise("security_alert")
    e = t["events"].select(
        F.col("event_id").alias("id"), kind.alias("kind"), "event_type", (F.col("event_type") != "error").alias("success"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username"), F.lit("bad password").alias("error_message"),
        F.lit("record").alias("resource_type"), F.col("user_id").cast("string").alias("resource_id"),
        F.when(F.col("event_type") == "view", F.lit(None)).otherwise("seen").alias("details"), F.lit("critical").alias("severity"),
        F.col("ts").alias("timestamp"), (F.col("user_id") % 4).alias("stream"))
    return P.audit_rows(e)


@query("c11_audit_rows", AUDIT + """
SELECT event_id AS id, CASE WHEN kind = 'auth' THEN CASE WHEN success THEN 'medium' ELSE 'high' END WHEN kind = 'data_access' THEN 'medium' ELSE 'critical' END AS severity,
 CASE WHEN kind = 'auth' AND success THEN concat('Authentication attempt for user ''u', CAST(user_id AS STRING), ''' succeeded')
  WHEN kind = 'auth' THEN concat('Authentication attempt for user ''u', CAST(user_id AS STRING), ''' failed: bad password')
  WHEN kind = 'data_access' THEN concat('User ''u', CAST(user_id AS STRING), ''' performed view on record ''', CAST(user_id AS STRING), '''')
  ELSE concat('Security Alert (', event_type, '): seen') END AS event_description,
 CASE WHEN kind = 'auth' THEN CASE WHEN success THEN '200' ELSE '401' END END AS response_status, ts + INTERVAL 2555 DAY AS expires_at,
 CASE WHEN kind = 'auth' THEN 'authentication' WHEN kind = 'data_access' THEN 'data_access' ELSE concat('security,alert,', event_type) END AS tags FROM a""")
def c11(t):
    return _audit(t).select("id", "severity", "event_description", "response_status", "expires_at", F.array_join("tags", ",").alias("tags"))


AUDIT_COLS = ["id", "event_type", "username"]


@query("j11_audit_integrity", "SELECT event_id AS id FROM events WHERE event_id % 50 = 7")
def j11(t):
    rows = _audit(t).withColumn("checksum", P.audit_checksum(AUDIT_COLS, "s"))
    forged = rows.withColumn("username", F.when(F.col("id") % 50 == 7, "mallory").otherwise(F.col("username")))
    return P.tampered(forged, AUDIT_COLS, "s").select("id")


@query("j11_audit_checksum", """SELECT event_id AS id, sha256(concat('{"event_type":"', event_type, '","id":', CAST(event_id AS STRING), ',"username":"u', CAST(user_id AS STRING), '"}', 's')) AS checksum FROM events""")
def j11b(t):
    return _audit(t).select("id", P.audit_checksum(AUDIT_COLS, "s").alias("checksum"))


CHAIN = """
WITH c AS (SELECT event_id, user_id % 4 AS stream, ts, sha256(concat('{"event_type":"', event_type, '","id":', CAST(event_id AS STRING), ',"username":"u', CAST(user_id AS STRING), '"}', 's')) AS checksum FROM events)
"""


@query("g3_audit_chain", CHAIN + "SELECT event_id AS id, lag(checksum) OVER (PARTITION BY stream ORDER BY ts, event_id) AS previous_checksum FROM c")
def g3(t):
    rows = _audit(t).withColumn("checksum", P.audit_checksum(AUDIT_COLS, "s"))
    return A.audit_chain(rows, "stream", "timestamp", "id").select("id", "previous_checksum")


@query("g3_audit_breaks", CHAIN + """, o AS (SELECT event_id, lag(event_id) OVER (PARTITION BY stream ORDER BY ts, event_id) AS before FROM c)
SELECT event_id AS id FROM o WHERE event_id % 40 = 3 OR before % 50 = 7""")
def g3b(t):
    rows = _audit(t).withColumn("checksum", P.audit_checksum(AUDIT_COLS, "s"))
    chained = A.audit_chain(rows, "stream", "timestamp", "id")
    # two kinds of tampering: a changed link, and an entry whose own checksum was replaced
    forged = chained.withColumns({
        "previous_checksum": F.when(F.col("id") % 40 == 3, "0").otherwise(F.col("previous_checksum")),
        "checksum": F.when(F.col("id") % 50 == 7, "1").otherwise(F.col("checksum"))})
    return A.audit_breaks(forged, "stream", "timestamp", "id").select("id")
