"""Registered queries with their SQL."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
MODULES = ("prep", "scoring", "contrasts", "events", "audits", "controls")


def query(name: str, sql: str | None = None):
    """Register the decorated (spark, sf_dir) function as ``name``."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def load() -> tuple[dict, dict[str, str]]:
    for m in MODULES:
        import_module(f"{__package__}.{m}")
    return QUERIES, ORACLE
