"""Query catalog: importing the modules registers their queries."""

from __future__ import annotations

import importlib

from tidemark.plans import registry

MODULES = ("windows", "tables", "files", "portfolio", "experiments", "events", "content", "models", "streams")


def load():
    for name in MODULES:
        importlib.import_module(f"tidemark.plans.catalog.{name}")
    return registry
