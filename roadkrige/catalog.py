"""All queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

from .plans.registry import ORACLE_SQL, QUERIES

MODULES = ("relational", "scalar", "spatial", "network", "models")


def _load() -> None:
    for name in MODULES:
        import_module(f"roadkrige.plans.{name}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(ORACLE_SQL)
