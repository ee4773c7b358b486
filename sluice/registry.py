"""Queries by name, with the SQL that DuckDB can check them by.

Labels: R, behaviour of the surveyed pages; D, Spark's public surface and the
test tables; P, work that the pages only describe, with semantics of our own
on stand-in columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    label: str


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None, label: str = "D"):
    """Register a query under name; sql is its DuckDB equivalent, if there is one."""

    def wrap(f):
        if name in ENTRIES:
            raise ValueError(f"two queries are named {name}")
        ENTRIES[name] = Entry(f, sql, label)
        return f

    return wrap
