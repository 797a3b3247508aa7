"""Where queries register themselves, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import adapters

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *panels: str):
    """Registers a query; ``panels`` are the adapter panels that its SQL reads."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = adapters.sql(sql, *panels)
        return f

    return add
