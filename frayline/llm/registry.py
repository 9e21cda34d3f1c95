"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib
import pkgutil

from frayline.llm import queries as modules


def _modules() -> list:
    names = sorted(m.name for m in pkgutil.iter_modules(modules.__path__))
    return [importlib.import_module(f"{modules.__name__}.{name}") for name in names]


def queries() -> dict:
    return {name: run for m in _modules() for name, run in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in getattr(m, "SQL", {}).items()}
