"""The registered queries: one per operator, with the SQL each must agree with."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Entry:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}

SECTIONS = ["sources", "imports", "filters", "joins", "aggregates", "windows", "ordering", "functions",
            "graph", "changes", "resolution", "verification", "drafts", "sheets", "outputs", "streams"]


def query(name: str, sql: str | None = None):
    """Register ``fn(t)`` where ``t`` is the table loader for one data folder."""
    def wrap(fn):
        from plotline.sources.tables import Tables

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))
        if name in ENTRIES:
            raise ValueError(f"query {name} is registered twice")
        ENTRIES[name] = Entry(name, run, sql)
        return fn
    return wrap


def load() -> dict[str, Entry]:
    for section in SECTIONS:
        importlib.import_module(f"plotline.registry.{section}")
    return ENTRIES
