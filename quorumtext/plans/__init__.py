"""Registered queries."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """Import every ``*_queries`` module and return the catalog."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module.name}")
    return importlib.import_module(f"{__name__}.catalog")
