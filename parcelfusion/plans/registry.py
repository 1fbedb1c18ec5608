"""All registered queries of the parcel engine, and their checking SQL."""

from __future__ import annotations

from . import layer_queries, match_queries, shape_queries, table_queries

_ALL = match_queries.QUERIES | layer_queries.QUERIES | table_queries.QUERIES | shape_queries.QUERIES


def queries() -> dict:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
