"""Named queries over the given tables."""

from __future__ import annotations

import importlib

MODULES = ["base_queries", "stay_queries", "link_queries", "graph_queries", "chain_queries"]


def load_all():
    """Import every query module and return ``(queries, oracle SQL)``."""
    for module in MODULES:
        importlib.import_module(f"stayweave.plans.{module}")
    from stayweave.plans import registry

    return dict(registry.QUERIES), dict(registry.ORACLES)
