"""Registered queries over the given tables, by theme."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> None:
    """Import every module of this package, which registers its queries."""
    for m in pkgutil.iter_modules(__path__, f"{__name__}."):
        importlib.import_module(m.name)
