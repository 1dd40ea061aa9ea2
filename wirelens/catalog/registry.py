"""Registry of queries: a callable, an optional SQL twin and the survey ids covered."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from wirelens.catalog import sqlviews


@dataclass(frozen=True)
class Entry:
    name: str
    covers: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, covers: str, sql: str | None = None, views: str = ""):
    """Register ``fn(spark, sf_dir)``; ``views`` names the SQL views the twin needs."""

    def register(fn):
        text = sqlviews.compose(views.split(), sql) if sql is not None else None
        REGISTRY[name] = Entry(name, tuple(covers.split()), fn, text)
        return fn

    return register
