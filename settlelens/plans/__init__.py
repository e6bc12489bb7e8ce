"""Registered queries, their adapters over the supplied tables, and the end-to-end daily plan."""

from __future__ import annotations

import importlib

_MODULES = [
    "function_queries", "panel_queries", "chain_queries", "check_queries", "stat_queries", "file_queries", "event_queries", "analytic_queries",
]


def registered():
    """All catalogue entries; importing the query modules fills the catalogue."""
    from settlelens.plans.catalogue import CATALOGUE

    for name in _MODULES:
        importlib.import_module(f"settlelens.plans.{name}")
    return dict(sorted(CATALOGUE.items()))
