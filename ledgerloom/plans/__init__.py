"""End-to-end plans and the query registry."""

from __future__ import annotations

import importlib

MODULES = ("sources", "validate", "reconcile", "quality", "measures", "documents", "relations", "time", "search")


def load() -> dict:
    """All registered queries by name."""
    for module in MODULES:
        importlib.import_module(f"ledgerloom.plans.queries_{module}")
    from ledgerloom.plans.registry import QUERIES

    return QUERIES
