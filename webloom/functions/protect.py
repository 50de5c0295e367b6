"""Sensitive values: salted hashes, protected fields, log redaction, tamper-evident rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.common import any_of, clip, col

# Parts of field names that mark a sensitive value; headers that are never logged.
SENSITIVE = ("email", "phone", "address", "ssn", "credit_card", "password", "token", "key", "secret", "api_key")
SECRET_HEADERS = ("authorization", "cookie", "x-api-key", "x-auth-token", "proxy-authorization")
FORWARDED = ("x-forwarded-for", "x-real-ip", "x-client-ip", "cf-connecting-ip")
MARK = "enc:"


def salted_hash(data: Column | str, salt: Column | str) -> Column:
    data, salt = col(data), F.lit(salt) if isinstance(salt, str) else salt
    return F.concat(F.sha2(F.concat(data, salt), 256), F.lit(":"), salt)


def hash_matches(data: Column | str, stored: Column | str) -> Column:
    return salted_hash(col(data), F.substring_index(col(stored), ":", -1)) == col(stored)


def is_sensitive(name: Column) -> Column:
    return any_of(F.lower(name).contains(s) for s in SENSITIVE)


def protect(content: Column | str, key: Column) -> Column:
    """Map with the values of sensitive keys encrypted (AES-GCM, marked so that the inverse knows them)."""
    return F.transform_values(col(content), lambda k, v: F.when(
        is_sensitive(k) & v.isNotNull(), F.concat(F.lit(MARK), F.base64(F.aes_encrypt(v, key)))).otherwise(v))


def unprotect(content: Column | str, key: Column) -> Column:
    """Inverse of ``protect``; a value that this key does not open stays as it is."""
    return F.transform_values(col(content), lambda k, v: F.coalesce(F.when(
        v.startswith(MARK), F.try_aes_decrypt(F.unbase64(F.substr(v, F.lit(len(MARK) + 1))), key).cast("string")), v))


def filter_headers(headers: Column | str) -> Column:
    """Secrets hidden, the user agent clipped."""
    return F.transform_values(col(headers), lambda k, v: F.when(F.lower(k).isin(*SECRET_HEADERS), F.lit("[REDACTED]"))
                              .when(F.lower(k) == "user-agent", clip(v, 100)).otherwise(v))


def client_ip(headers: Column | str, peer: Column | str) -> Column:
    """First address a proxy names, else the peer."""
    headers = col(headers)
    named = [F.nullif(F.trim(F.split_part(headers[h], F.lit(","), F.lit(1))), F.lit("")) for h in FORWARDED]
    return F.coalesce(*named, col(peer), F.lit("unknown"))


def query_params(url: Column | str) -> Column:
    """Map of the decoded query parameters of a URL, the last value of a name; null without any. A part without ``=``
    or a name is left out; text that is no valid escape stays as it is."""

    def plain(x: Column) -> Column:
        return F.coalesce(F.try_url_decode(x), x)

    text = F.regexp_extract(col(url), r"^[^?#]*\?([^#]*)", 1)
    parts = F.filter(F.split(text, "&"), lambda p: p.rlike("^[^=]+="))
    named = F.transform(parts, lambda p: F.struct(plain(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), plain(F.regexp_extract(p, "(?s)^[^=]+=(.*)", 1)).alias("v")))
    last = F.transform(F.array_distinct(named["k"]), lambda k: F.struct(k, F.element_at(F.filter(named, lambda x: x["k"] == k), -1)["v"]))
    return F.when(F.size(parts) > 0, F.map_from_entries(last))


def request_log(df: DataFrame, headers: str = "headers", peer: str = "peer") -> DataFrame:
    """Requests as they are logged: client, size, type and agent from the headers, secrets hidden."""
    h = F.col(headers)
    return df.withColumns({
        "client_ip": client_ip(headers, peer),
        "body_size_bytes": F.coalesce(h["content-length"].try_cast("long"), F.lit(0)),
        "content_type": h["content-type"],
        "user_agent": h["user-agent"],
    }).withColumn(headers, filter_headers(headers))


def request_target(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``path`` (``/`` if empty) and ``query_params`` of the requested URL."""
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    return df.withColumns({"path": F.when(path == "", "/").otherwise(path), "query_params": query_params(url)})


def response_log(df: DataFrame, seconds: str = "seconds", headers: str = "headers", slow: float = 5.0) -> DataFrame:
    """Responses as they are logged: size, type, time to the millisecond, whether it took longer than ``slow`` seconds;
    an unknown time is not slow. Secrets are hidden."""
    h = F.col(headers)
    return df.withColumns({
        "body_size_bytes": F.coalesce(h["content-length"].try_cast("long"), F.lit(0)),
        "content_type": h["content-type"],
        "processing_time_seconds": F.round(seconds, 3),
        "is_slow": F.coalesce(F.col(seconds) > slow, F.lit(False)),
    }).withColumn(headers, filter_headers(headers))


def audit_rows(events: DataFrame, retention_days: int = 2555) -> DataFrame:
    """Audit row per event (kind: auth, data_access or security_alert) with severity, text, status, expiry."""
    c = F.col
    auth, access = c("kind") == "auth", c("kind") == "data_access"
    attempt = F.format_string("Authentication attempt for user '%s'", c("username"))
    described = (
        F.when(auth & c("success"), F.concat(attempt, F.lit(" succeeded")))
        .when(auth & c("error_message").isNotNull(), F.concat(attempt, F.lit(" failed: "), c("error_message")))
        .when(auth, attempt)
        .when(access, F.concat(
            F.format_string("User '%s' performed %s on %s '%s'", "username", "event_type", "resource_type", "resource_id"),
            F.coalesce(F.concat(F.lit(": "), c("details")), F.lit(""))))
        .otherwise(F.format_string("Security Alert (%s): %s", c("event_type"), c("details")))
    )
    severity = F.when(auth, F.when(c("success"), "medium").otherwise("high")).when(access, "medium").otherwise(c("severity"))
    tags = F.when(auth, F.array(F.lit("authentication"))).when(access, F.array(F.lit("data_access"))) \
        .otherwise(F.array(F.lit("security"), F.lit("alert"), F.lower("event_type")))
    return events.withColumns({
        "event_description": described, "severity": severity, "tags": tags,
        "response_status": F.when(auth, F.when(c("success"), "200").otherwise("401")),
        "expires_at": c("timestamp") + F.expr(f"INTERVAL {int(retention_days)} DAY"),
    })


def audit_checksum(columns: Sequence[str], salt: str) -> Column:
    """sha256 over the row as JSON with its keys in order, and the salt."""
    row = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
    return F.sha2(F.concat(row, F.lit(salt)), 256)


def tampered(rows: DataFrame, columns: Sequence[str], salt: str, checksum: str = "checksum") -> DataFrame:
    return rows.where(audit_checksum(columns, salt) != F.col(checksum))
