"""Registered queries with their SQL twins, grouped by area."""

from wirelens.catalog.registry import REGISTRY, Entry, query

__all__ = ["REGISTRY", "Entry", "load", "query"]


def load() -> dict[str, Entry]:
    from wirelens.catalog import areas

    areas.import_all()
    return REGISTRY
