"""URL columns: host, joining a relative reference to its page, checks and normal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.common import all_of, any_of, col

SCHEME = "^[a-zA-Z][a-zA-Z0-9+.-]*:"
AUTHORITY = "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"

# Schemes never accepted, and the full form of a job URL.
DANGEROUS_SCHEMES = ("javascript", "data", "vbscript", "file", "ftp")
JOB_URL = (
    r"(?i)^https?://"
    r"(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?|localhost|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
    r"(?::\d+)?(?:/?|[/?]\S+)$"
)
# Link targets that are not pages.
NOT_PAGES = ("#", "javascript:", "mailto:", "tel:")


def host(url: Column | str) -> Column:
    """Authority part in lower case, '' where there is none."""
    return F.lower(F.regexp_extract(col(url), AUTHORITY, 1))


def scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(url), "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))


def path(url: Column | str) -> Column:
    return F.regexp_extract(col(url), "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def _without_dots(path: Column) -> Column:
    """Path with '.' and '..' segments resolved."""
    parts = F.split(path, "/", -1)
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(p == ".", acc).otherwise(F.array_append(acc, p)),
    )
    last_is_dir = F.element_at(parts, -1).isin(".", "..")
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(last_is_dir & ~joined.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined)


def resolve(base: Column | str, ref: Column | str) -> Column:
    """Absolute URL of ``ref`` found on page ``base``."""
    base, ref = col(base), F.trim(col(ref))
    root = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    ref_path = F.regexp_extract(ref, "^([^?#]*)", 1)
    tail = F.regexp_extract(ref, "^[^?#]*(.*)$", 1)
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)

    def tidy(p: Column) -> Column:
        return F.when(p.rlike(r"/\.\.?(/|$)"), _without_dots(p)).otherwise(p)

    return (
        F.when(ref.rlike(SCHEME), ref)
        .when(ref.startswith("//"), F.concat(F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), ref))
        .when(ref == "", base)
        .when(ref.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), ref))
        .when(ref.startswith("?"), F.concat(F.regexp_replace(base, "[?#].*$", ""), ref))
        .when(ref.startswith("/"), F.concat(root, tidy(ref_path), tail))
        .otherwise(F.concat(root, tidy(F.concat(folder, ref_path)), tail))
    )


def is_page_link(href: Column | str) -> Column:
    href = F.trim(col(href))
    return (href != "") & ~any_of(href.startswith(p) for p in NOT_PAGES)


def is_external(url: Column | str, base: Column | str) -> Column:
    return host(url) != host(base)


def leaves_host(base_host: Column, ref: Column) -> Column:
    """Whether a reference leads to another host than the page's; only one that names a host can."""
    ref = F.trim(ref)
    named = F.lower(F.regexp_extract(ref, "^//([^/?#]*)", 1))
    return F.when(ref.rlike(SCHEME), host(ref) != base_host).when(ref.startswith("//"), named != base_host).otherwise(F.lit(False))


def has_web_prefix(url: Column | str) -> Column:
    url = col(url)
    return F.coalesce(url.startswith("http://") | url.startswith("https://"), F.lit(False))


def is_job_url(url: Column | str) -> Column:
    return has_web_prefix(url) & F.coalesce(col(url).rlike(JOB_URL), F.lit(False))


def web_url(url: Column | str) -> Column:
    """Lenient normal form: a scheme is added where it is missing; null for dangerous schemes."""
    text = F.trim(col(url))
    full = (
        F.when(has_web_prefix(text), text)
        .when(text.startswith("//"), F.concat(F.lit("https:"), text))
        .when(text.startswith("ftp://") | text.startswith("file://"), text)
        .otherwise(F.concat(F.lit("https://"), text))
    )
    bad = any_of(F.lower(full).startswith(f"{s}:") for s in DANGEROUS_SCHEMES)
    return F.when(text == "", F.lit("")).when(~bad, full)


def without_credentials(url: Column | str) -> Column:
    """User and password removed; text without a host is hidden altogether."""
    url = col(url)
    name = F.regexp_replace(F.regexp_extract(url, AUTHORITY, 1), "^.*@", "")
    usable = name.rlike("^[^:]+(:[0-9]*)?$")
    clean = F.concat(
        F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.-]*://)", 1), F.lower(F.regexp_replace(name, ":$", "")),
        F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(.*)$", 1),
    )
    return F.when(F.coalesce(usable, F.lit(False)), clean).otherwise(F.lit("[REDACTED]"))


def web_ok(url: Column | str) -> Column:
    return all_of([has_web_prefix(url), host(url) != ""])
