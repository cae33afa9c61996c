"""The registered queries, grouped by subject."""

from __future__ import annotations

import importlib
import pkgutil

from tickloom.registry import QUERIES


def load() -> dict:
    """Import every plan module once and return the registry."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return QUERIES
