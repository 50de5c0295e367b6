"""Registry of runnable queries and of the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from webloom.sources.views import VIEW_DEPS, VIEW_SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def with_views(sql: str, views: Iterable[str]) -> str:
    """Prefix ``sql`` with the input views it names, each after those it is built from."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in VIEW_DEPS.get(name, ()):
            add(dep)
        if name not in order:
            order.append(name)

    for view in views:
        add(view)
    if not order:
        return sql.strip()
    ctes = ",\n".join(f"{name} AS ({VIEW_SQL[name]})" for name in order)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None, views: Iterable[str] = ()):
    """Register ``fn(tables) -> DataFrame`` under ``name``, with its SQL twin if it has one."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = with_views(sql, views)
        return fn

    return register
