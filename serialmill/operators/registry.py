"""Queries of a module by name, with their SQL twins."""

from __future__ import annotations


def registry():
    """(QUERIES, ORACLES, decorator) for one module."""
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(name: str, sql: str | None = None):
        def keep(f):
            queries[name] = f
            if sql:
                oracles[name] = sql
            return f

        return keep

    return queries, oracles, query
