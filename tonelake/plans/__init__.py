"""Named queries over the test tables."""

from __future__ import annotations

from importlib import import_module

GROUPS = ("scalar", "joins", "tiers", "stats", "contours", "sampling", "selection", "learning", "sources")


def load():
    from tonelake.plans import registry

    for g in GROUPS:
        import_module(f"tonelake.plans.{g}_queries")
    return registry.QUERIES, registry.ORACLES
