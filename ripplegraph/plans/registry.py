"""Registered queries and their SQL."""

from __future__ import annotations

from . import alias_queries, extra_queries, further_queries, impact_queries, more_queries, stored_queries, whole_queries

_PARTS = (impact_queries, more_queries, extra_queries, whole_queries, further_queries, alias_queries, stored_queries)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
