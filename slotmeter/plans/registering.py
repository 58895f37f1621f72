"""A module's registry: its queries and their DuckDB counterparts."""

from __future__ import annotations

from slotmeter.plans.fixtures import with_


def registry():
    """(queries, oracles, decorator): the decorator takes the SQL, or None, and CTEs of its own."""
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None, **more: str):
        def add(fn):
            queries[fn.__name__] = fn
            if sql is not None:
                oracles[fn.__name__] = with_(sql, **more)
            return fn

        return add

    return queries, oracles, query
