"""Registered queries and their DuckDB equivalents."""

from __future__ import annotations

from .plans import queries_geometry, queries_lines, queries_network, queries_sources, queries_text, queries_words

_PARTS = (queries_lines, queries_text, queries_geometry, queries_network, queries_words, queries_sources)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
