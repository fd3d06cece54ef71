"""All queries of the engine, with the SQL that defines the same result."""

from __future__ import annotations

from folioflow.plans import catalog, layout, legal, markdown, more, notes

_ALL = {**markdown.QUERIES, **layout.QUERIES, **legal.QUERIES, **catalog.QUERIES, **more.QUERIES, **notes.QUERIES}


def queries() -> dict:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
