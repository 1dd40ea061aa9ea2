"""Imports every module that registers queries."""

from importlib import import_module

AREAS = ["traffic", "protocol", "assessment", "evaluation", "auditing", "landing", "streams", "learning",
         "reports"]


def import_all() -> None:
    for area in AREAS:
        import_module(f"wirelens.catalog.{area}")
