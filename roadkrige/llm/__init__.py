"""Operators for preparing large text corpora.

Nothing outside this package imports it.  ``queries()`` and ``oracle_sql()``
collect what the modules of the package register.
"""

from __future__ import annotations

from importlib import import_module

_MODULES = (
    "quality", "jaccard", "exact", "mixing", "shards", "tokens", "packing", "topk", "urls", "substring", "balls", "phrases", "pii",

)


def queries() -> dict:
    out: dict = {}
    for name in _MODULES:
        out |= import_module(f"{__name__}.{name}").QUERIES
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for name in _MODULES:
        out |= import_module(f"{__name__}.{name}").ORACLE_SQL
    return out
