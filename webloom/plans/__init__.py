"""Runnable queries: each wires the stored tables into library operators."""

from __future__ import annotations

import importlib
import pkgutil

from webloom.plans.registry import ORACLE, QUERIES


def load():
    """Import every module of this package once; return (queries, sql)."""
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")
    return QUERIES, ORACLE
