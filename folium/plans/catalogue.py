"""All registered queries of the ledger and their SQL."""

from __future__ import annotations

import importlib

#: Modules with QUERIES (name: callable) and ORACLES (name: SQL).
_MODULES = ("ledger_queries", "quality_queries", "layout_queries", "mutation_queries", "submission_queries", "source_queries")


def _all(name: str) -> dict:
    found: dict = {}
    for module in _MODULES:
        found |= getattr(importlib.import_module(f"folium.plans.{module}"), name)
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLES")
