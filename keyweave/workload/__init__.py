"""The registered queries over the given tables, each with the SQL that defines its result."""

from __future__ import annotations

from keyweave.workload import boxes, catalog, checks, design, graph, schemas, search, store

FAMILIES = (search, checks, catalog, schemas, design, graph, boxes, store)


def all_queries() -> dict:
    return {name: query for family in FAMILIES for name, query in family.QUERIES.items()}


def all_sql() -> dict:
    return {name: sql for family in FAMILIES for name, sql in family.SQL.items()}
