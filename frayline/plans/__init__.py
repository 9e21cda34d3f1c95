"""Registered queries."""

from __future__ import annotations

import importlib
import pkgutil


def load_queries() -> dict:
    """Import every ``*_queries`` module and return the registry."""
    from frayline.plans.registry import QUERIES

    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module.name}")
    return QUERIES
