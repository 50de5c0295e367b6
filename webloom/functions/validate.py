"""Input checks: each gives ``struct<is_valid, value, errors, warnings>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.cleaning import EMAIL, squeeze, strip
from webloom.functions.common import any_of, col
from webloom.functions.urls import DANGEROUS_SCHEMES, host, scheme

# Patterns of dangerous input, in the order in which the first hit is reported.
DANGEROUS = (
    r"(\b(union|select|insert|update|delete|drop|create|alter|exec|execute)\b)",
    r"(--|#|/\*|\*/)",
    r"(\bor\b\s+\d+\s*=\s*\d+)",
    r"(\band\b\s+\d+\s*=\s*\d+)",
    r"<script[^>]*>.*?</script>",
    r"javascript:",
    r"vbscript:",
    r"on\w+\s*=",
    r"<iframe[^>]*>.*?</iframe>",
    r"<object[^>]*>.*?</object>",
    r"<embed[^>]*>.*?</embed>",
    r"[;&|`$(){}\[\]\\]",
    r"\b(cat|ls|dir|type|copy|move|del|rm|chmod|chown|sudo|su)\b",
    r"\.\./.*\.\.",
    r"\.\.[\\/]",
    r"[\\/]\.\.[\\/]",
    r"[()&|!]",
    r"\*.*\*",
    r"<!DOCTYPE",
    r"<!ENTITY",
    r"<!\[CDATA\[",
    r"\$where",
    r"\$ne",
    r"\$gt",
    r"\$lt",
    r"\$regex",
)
# The shorter list used for whole requests.
SUSPICIOUS = (
    r"<script[^>]*>.*?</script>",
    r"javascript:",
    r"on\w+\s*=",
    r"union\s+select",
    r"drop\s+table",
    r"insert\s+into",
    r"delete\s+from",
    r"\.\./.*\.\.",
    r"file://",
    r"php://",
    r"data://",
)
# Doubtful mail domains, and file names that some systems reserve.
DOUBTFUL_DOMAINS = (".tk", ".ml", ".ga", ".cf", "tempmail", "guerrillamail")
RESERVED_NAMES = ("CON", "PRN", "AUX", "NUL") + tuple(f"{d}{n}" for d in ("COM", "LPT") for n in range(1, 10))
FILE_NAME_CHARS = ("/", "\\", ":", "*", "?", '"', "<", ">", "|", "\x00")
JOB_STATUSES = ("pending", "running", "completed", "failed", "cancelled")
CONTENT_TYPES = ("html", "text", "json", "xml", "pdf", "csv")
EXPORT_FORMATS = ("csv", "json", "xlsx")

# Whether any of DANGEROUS occurs, for one scan: what another pattern implies is left out, words share one border, and a
# position where nothing can begin is passed at once.
ALL_DANGEROUS = (
    r"(?imU)[#;&|`$(){}\[\]\\!]"
    r"|(?=[-*/.<])(?:--|\*/|/\*|\*.*\*|\.\./|<script[^>]*>.*?</script>|<iframe[^>]*>.*?</iframe>|<object[^>]*>.*?</object>|<embed[^>]*>.*?</embed>)"
    r"|(?=[ojv])(?:on\w+\s*=|javascript:|vbscript:)"
    r"|(?=[acdeilmorstu])\b(?:(?:union|select|insert|update|delete|drop|create|alter|exec|execute"
    r"|cat|ls|dir|type|copy|move|del|rm|chmod|chown|sudo|su)\b|(?:or|and)\b\s+\d+\s*=\s*\d+)"
)
ALL_SUSPICIOUS = "(?iU)" + "|".join(f"(?:{p})" for p in SUSPICIOUS)


def is_dangerous(text: Column | str) -> Column:
    """One alternation, so that the text is scanned by one matcher."""
    return F.coalesce(col(text).rlike(ALL_DANGEROUS), F.lit(False))


def is_suspicious(text: Column | str) -> Column:
    return F.coalesce(col(text).rlike(ALL_SUSPICIOUS), F.lit(False))


def dangerous_match(text: Column | str) -> Column:
    """Text matched by the first pattern of the list that occurs; null if none does."""
    text = col(text)
    hits = F.coalesce(*[F.nullif(F.regexp_extract(text, "(?imU)" + p, 0), F.lit("")) for p in DANGEROUS])
    return F.when(is_dangerous(text), hits)


def _result(valid: Column, value: Column, errors: Column, warnings: Column) -> Column:
    return F.struct(valid.alias("is_valid"), value.alias("value"), errors.alias("errors"), warnings.alias("warnings"))


def _messages(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in pairs])).cast("array<string>")


def _none() -> Column:
    return F.array().cast("array<string>")


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def check_string(
    text: Column | str, max_length: int = 1000, min_length: int = 0, special: bool = True, required: bool = False,
    name: str = "input",
) -> Column:
    raw = col(text)
    value = F.coalesce(raw, F.lit(""))
    kept = F.substring(value, 1, max_length)
    too_long = F.length(value) > max_length
    errors = _messages(
        (too_long, f"{name} exceeds maximum length of {max_length} characters"),
        (F.length(kept) < min_length, f"{name} must be at least {min_length} characters long"),
        (is_dangerous(value), f"{name} contains potentially dangerous content"),
    )
    clean = escape_html(kept)
    if not special:
        clean = F.regexp_replace(clean, r"(?U)[^\w\s\-_.,!?]", "")
    clean = squeeze(F.regexp_replace(clean, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""))
    ok = _result(F.size(errors) == 0, clean, errors, _messages((too_long, f"{name} was truncated to {max_length} characters")))
    if not required:
        return ok
    missing = _result(F.lit(False), F.lit(None).cast("string"), F.array(F.lit(f"{name} is required")), _none())
    return F.when(raw.isNull(), missing).otherwise(ok)


def _blank(value: Column, required: bool, name: str, empty: str) -> Column:
    """Result for a missing or empty value."""
    errors = F.when(value.isNull(), F.array(F.lit(f"{name} is required"))).otherwise(F.array(F.lit(empty))) if required else _none()
    return _result(F.lit(not required), value, errors, _none())


def check_email(text: Column | str, required: bool = False, name: str = "email") -> Column:
    value = F.lower(strip(text))
    errors = _messages(
        (~value.rlike(EMAIL), f"{name} is not a valid email address"),
        (is_dangerous(value), f"{name} contains potentially dangerous content"),
        (F.length(value) > 254, f"{name} exceeds maximum email length"),
    )
    warnings = _messages((any_of(value.contains(d) for d in DOUBTFUL_DOMAINS), f"{name} uses a suspicious domain"))
    ok = F.size(errors) == 0
    full = _result(ok, F.when(ok, value), errors, warnings)
    return F.when(F.coalesce(value, F.lit("")) == "", _blank(value, required, name, f"{name} cannot be empty")).otherwise(full)


def _quote(text: Column, keep: str) -> Column:
    """Percent-encoding of everything but letters, digits, ``_.-~`` and ``keep``."""
    coded = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    coded = F.replace(F.replace(coded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    for char in keep:
        coded = F.replace(coded, F.lit(f"%{ord(char):02X}"), F.lit(char))
    return coded


def check_url(text: Column | str, schemes: tuple[str, ...] = ("http", "https"), required: bool = False, name: str = "url") -> Column:
    value = strip(text)
    kind = scheme(value)
    errors = _messages(
        (~kind.isin(*[s.lower() for s in schemes]), f"{name} must use one of these schemes: {', '.join(schemes)}"),
        (kind.isin(*DANGEROUS_SCHEMES), f"{name} uses dangerous scheme"),
        (host(value) == "", f"{name} must include a valid hostname"),
        (is_dangerous(value), f"{name} contains potentially dangerous content"),
    )
    rest = F.regexp_extract(value, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(.*)$", 1)
    where = _quote(F.regexp_extract(rest, "^([^?#]*)", 1), "/")
    asked = _quote(F.regexp_extract(rest, r"\?([^#]*)", 1), "&=")
    inside = _quote(F.regexp_extract(rest, "#(.*)$", 1), "")
    clean = F.concat(
        kind, F.lit("://"), host(value), where, F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(""),
        F.when(inside != "", F.concat(F.lit("#"), inside)).otherwise(""))
    ok = F.size(errors) == 0
    full = _result(ok, F.when(ok, clean), errors, _messages((is_dangerous(value), "URL contains suspicious patterns")))
    return F.when(F.coalesce(value, F.lit("")) == "", _blank(value, required, name, f"{name} cannot be empty")).otherwise(full)


def check_filename(text: Column | str, max_length: int = 255, required: bool = False, name: str = "filename") -> Column:
    value = strip(text)
    safe = value
    warned = []
    for char in FILE_NAME_CHARS:
        warned.append((value.contains(char), f"Replaced dangerous character '{char}' with '_'"))
        safe = F.replace(safe, F.lit(char), F.lit("_"))
    warned.append((safe.contains(".."), "Removed path traversal attempt"))
    safe = F.regexp_replace(F.replace(safe, F.lit(".."), F.lit("_")), "^[. ]+|[. ]+$", "")
    warned.append((safe == "", "Generated default filename"))
    safe = F.when(safe == "", "unnamed_file").otherwise(safe)
    long = F.length(safe) > max_length
    warned.append((long, f"Truncated filename to {max_length} characters"))
    ext = F.substring_index(safe, ".", -1)
    stem = F.substring(safe, F.lit(1), F.length(safe) - F.length(ext) - 1)
    short = F.when(
        safe.contains("."),
        F.concat(F.substring(stem, F.lit(1), F.greatest(F.lit(max_length) - F.length(ext) - 1, F.lit(0))), F.lit("."), ext),
    ).otherwise(F.substring(safe, 1, max_length))
    safe = F.when(long, short).otherwise(safe)
    reserved = F.upper(F.substring_index(safe, ".", 1)).isin(*RESERVED_NAMES)
    warned.append((reserved, "Added prefix to avoid reserved filename"))
    safe = F.when(reserved, F.concat(F.lit("file_"), safe)).otherwise(safe)
    full = _result(F.lit(True), safe, _none(), _messages(*warned))
    return F.when(F.coalesce(value, F.lit("")) == "", _blank(value, required, name, f"{name} cannot be empty")).otherwise(full)


def check_uuid(text: Column | str, required: bool = False, name: str = "uuid") -> Column:
    raw = col(text)
    digits = F.regexp_replace(F.lower(strip(raw)), r"^urn:|uuid:|[{}-]", "")
    valid = digits.rlike("^[0-9a-f]{32}$")
    shown = F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    full = _result(valid, F.when(valid, shown), _messages((~valid, f"{name} is not a valid UUID")), _none())
    return F.when(raw.isNull(), _blank(raw, required, name, "")).otherwise(full)


# --- open JSON -----------------------------------------------------------------------------

NODE = "array<struct<path:array<int>,key:string,value:variant>>"
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def _members(value: Column) -> Column:
    """(key, value) of an object's members, by name; null for anything else."""
    return F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))


def _items(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _children(node: Column) -> Column:
    """The nodes below a node, with their paths; none below a scalar."""
    def place(i: Column) -> Column:
        return F.concat(node["path"], F.array(i))

    def named(e: Column, i: Column) -> Column:
        return F.struct(place(i).alias("path"), e["key"].alias("key"), e["value"].alias("value"))

    def numbered(v: Column, i: Column) -> Column:
        return F.struct(place(i).alias("path"), F.lit(None).cast("string").alias("key"), v.alias("value"))

    return F.coalesce(F.transform(_members(node["value"]), named), F.transform(_items(node["value"]), numbered), F.array().cast(NODE))


def json_levels(df: DataFrame, text: str, deepest: int, name: str = "__level") -> DataFrame:
    """Adds ``name``_0 ... ``name``_deepest: the nodes of each depth of a JSON text, in order of their paths.

    One bounded round per depth inside the row: no shuffle, and each depth is built once. Members of an object are
    numbered by name. Null and what is no JSON give null, at all depths.
    """
    doc = F.try_parse_json(text)
    root = F.array(F.struct(F.array().cast("array<int>").alias("path"), F.lit(None).cast("string").alias("key"), doc.alias("value"))).cast(NODE)
    out = df.withColumn(f"{name}_0", F.when(doc.isNotNull(), root))
    for depth in range(1, deepest + 1):
        out = out.withColumn(f"{name}_{depth}", F.flatten(F.transform(f"{name}_{depth - 1}", _children)))
    return out


def json_nodes(df: DataFrame, key: str, text: str, deepest: int = 10) -> DataFrame:
    """(key, path, depth, name, kind, size, value): one row per node of a JSON text, down to depth ``deepest``.

    ``path`` has the member or item numbers from the root, ``size`` the members of an object or items of an array,
    ``value`` the text of a scalar.
    """
    levels = json_levels(df.select(key, text), text, deepest)
    nodes = levels.select(key, F.explode(F.concat(*[F.col(f"__level_{d}") for d in range(deepest + 1)])).alias("n"))
    members, items = _members(F.col("n.value")), _items(F.col("n.value"))
    found = nodes.select(key, "n.path", "n.key", F.size(members).alias("members"), F.size(items).alias("items"), F.col("n.value").alias("v"))
    kind = F.when(F.col("members").isNotNull() & (F.col("members") >= 0), "object").when(F.col("items").isNotNull() & (F.col("items") >= 0), "array")
    scalar = F.schema_of_variant("v")
    simple = F.when(scalar == "STRING", "string").when(scalar == "BOOLEAN", "boolean").when(scalar == "VOID", "null").otherwise("number")
    return found.withColumn("kind", F.coalesce(kind, simple)).select(
        key, "path", F.size("path").alias("depth"), F.col("key").alias("name"), "kind",
        F.when(F.col("kind") == "object", F.col("members")).when(F.col("kind") == "array", F.col("items")).alias("size"),
        F.when(~F.col("kind").isin("object", "array"), F.try_variant_get("v", "$", "string")).alias("value"))


def _too_deep(text: Column, max_depth: int) -> Column:
    """For a text that did not parse: its brackets match in number and nest deeper than allowed."""
    brackets = F.split(F.regexp_replace(F.regexp_replace(text, STRING, ""), r"[^\[\]{}]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(state: Column, c: Column) -> Column:
        now = state["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))

    return F.aggregate(brackets, start, step, lambda state: (state["now"] == 0) & (state["most"] > max_depth + 1))


def _json_fault(node: Column, depth: int, max_depth: int, max_keys: int, max_items: int) -> Column:
    """struct<path, rank, error> of the first fault of a node; null error where it has none."""
    value = node["value"]
    text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
    deep = F.lit(depth > max_depth)
    # a key is looked at before its value
    faults = [(node["key"].rlike(ALL_DANGEROUS), "contains a dangerous pattern"), (deep, f"exceeds maximum depth of {max_depth}")]
    if depth <= max_depth:
        faults += [(F.size(_members(value)) > max_keys, f"object has too many keys (max: {max_keys})"),
                   (F.size(_items(value)) > max_items, "array is too large"), (text.rlike(ALL_DANGEROUS), "contains a dangerous pattern")]
    error = F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), F.lit(message)) for test, message in faults])
    return F.struct(node["path"].alias("path"), error.alias("error"))


def _escaped_json(text: Column) -> Column:
    """A JSON text, as Spark writes it, with the string values (not the keys) escaped for HTML and blanks after , and :"""
    def token(t: Column) -> Column:
        plain = F.regexp_replace(t, r"(?<!\\)((?:\\\\)*+)\\u0000", "$1")
        inner = F.substring(plain, F.lit(2), F.length(plain) - 2)
        for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('\\"', "&quot;"), ("'", "&#x27;")):
            inner = F.replace(inner, F.lit(raw), F.lit(safe))
        return F.when(~t.startswith('"'), F.replace(t, F.lit(","), F.lit(", "))).when(t.endswith(":"), F.concat(t, F.lit(" "))).otherwise(
            F.concat(F.lit('"'), inner, F.lit('"')))

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f'({STRING}:?|[^"]++)'), F.lit(1)), token), "")


def check_json(df: DataFrame, text: str, max_depth: int = 10, max_keys: int = 100, max_items: int = 1000) -> DataFrame:
    """Adds is_valid, error and value, the copy with escaped strings.

    ``error`` is the first fault in order of paths, members of an object by name: too deep, an object with too many
    keys, an array with too many items, a key or string that looks dangerous. A text nested deeper than the parser goes
    is too deep as well. An object that names a member twice is no valid JSON here. Null is valid and has no copy.
    """
    levels = json_levels(df, text, max_depth + 1)
    doc = F.col("__level_0")[0]["value"]

    def faults(depth: int) -> Column:
        return F.filter(F.transform(f"__level_{depth}", lambda n: _json_fault(n, depth, max_depth, max_keys, max_items)), lambda f: f["error"].isNotNull())

    found = F.concat(*map(faults, range(max_depth + 2)))
    unread = F.when(_too_deep(F.col(text), max_depth), f"exceeds maximum depth of {max_depth}").otherwise("is not valid JSON")
    error = F.when(F.col(text).isNotNull(), F.when(F.col("__level_0").isNull(), unread).otherwise(F.array_min(found)["error"]))
    out = levels.withColumn("error", error).withColumn("is_valid", F.col("error").isNull())
    value = F.when(F.col("is_valid"), _escaped_json(F.to_json(doc)))
    return out.withColumn("value", value).select(*[c for c in df.columns if c not in ("is_valid", "error", "value")], "is_valid", "error", "value")


def json_profile(df: DataFrame, key: str, text: str) -> DataFrame:
    """Top-level keys of a JSON column: (key, name, type, items) with the length of arrays."""
    docs = df.select(key, F.try_parse_json(text).alias("doc"))
    parts = docs.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("doc").outer()))
    kind = F.schema_of_variant("value")
    simple = (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").otherwise("number"))
    items = F.when(kind.startswith("ARRAY"), F.json_array_length(F.to_json("value")))
    return parts.select(key, F.col("key").alias("name"), simple.alias("type"), items.alias("items"))


# --- coercion and schema -------------------------------------------------------------------

def ensure_string(value: Column | str) -> Column:
    return F.coalesce(col(value).cast("string"), F.lit(""))


def ensure_float(value: Column | str) -> Column:
    return F.coalesce(col(value).try_cast("double"), F.lit(0.0))


def ensure_list(value: Column | str, is_list: bool) -> Column:
    value = col(value)
    return F.coalesce(value, F.array().cast("array<string>")) if is_list else F.array_compact(F.array(value))


def ensure_map(value: Column | str) -> Column:
    return F.coalesce(col(value), F.create_map().cast("map<string,string>"))


def ensure_timestamp(value: Column | str) -> Column:
    return F.try_to_timestamp(F.replace(col(value), F.lit("Z"), F.lit("+00:00")))


def schema_gaps(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Expected columns that are missing or of another type: (column, problem, rows), from one scan.

    ``rows`` counts what the gap spoils: all rows for a missing column, else those whose value is lost by a cast (every
    value, where one of the types is nested). No gaps give no rows.
    """
    def spoils(name: str, kind: str) -> Column:
        if name not in have:
            return F.count(F.lit(1))
        if any(t.startswith(("array", "map", "struct", "variant", "binary")) for t in (kind, have[name])):
            return F.count(F.col(name))
        return F.count_if(F.col(name).isNotNull() & F.col(name).try_cast(kind).isNull())

    have = dict(df.dtypes)
    gaps = {name: "missing" if name not in have else f"is {have[name]}, expected {kind}" for name, kind in expected.items() if have.get(name) != kind}
    told = [F.struct(F.lit(n).alias("column"), F.lit(problem).alias("problem"), spoils(n, expected[n]).alias("rows")) for n, problem in gaps.items()]
    found = F.array(*told).cast("array<struct<column:string,problem:string,rows:bigint>>")
    return df.agg(found.alias("gaps")).select(F.inline("gaps"))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows breaking each rule (rule, violations): one scan for all rules."""
    counted = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
    return counted.select(F.explode(pairs).alias("p")).select("p.*")
