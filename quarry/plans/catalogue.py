"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from quarry.plans import entities, graphs, histories, records, reports, searches, texts

MODULES = (searches, histories, texts, graphs, reports, entities, records)


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
