"""All queries of the library and their SQL."""

from __future__ import annotations

from lathe.plans import analytics_queries, effect_queries, io_queries, relation_queries, text_queries

MODULES = [analytics_queries, effect_queries, relation_queries, text_queries, io_queries]


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
