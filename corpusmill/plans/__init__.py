"""Queries over the driver tables, each with its oracle where SQL has one."""

from __future__ import annotations

from importlib import import_module

from .common import Query

MODULES = ("shares", "labels", "methods", "texts", "merges", "reviews", "records", "pages", "corpus", "flows", "links")


def _registries():
    return [import_module(f"{__name__}.{m}").registry for m in MODULES]


def queries() -> dict[str, Query]:
    return {k: f for r in _registries() for k, f in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for r in _registries() for k, s in r.sql.items()}
