"""Registered queries: each operator over whole tables, with equivalent SQL where SQL can say it."""

from __future__ import annotations

import importlib

MODULES = ["filters", "joins", "statistics", "ordering", "scalar", "maintenance", "validation",
           "retrieval", "texts", "ontology", "policy", "web", "composite", "streams"]


def load() -> tuple[dict, dict]:
    """All queries and the SQL of those that have it."""
    for name in MODULES:
        importlib.import_module(f"regulith.catalog.{name}")
    from regulith.catalog.base import ORACLES, QUERIES

    return QUERIES, ORACLES
