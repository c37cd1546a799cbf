"""Names, functions and oracle SQL of the queries in this subpackage."""

from __future__ import annotations

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register
