"""All registered queries of the evidence engine and the SQL that states the same rows."""

from __future__ import annotations

from pivotloom.plans import binding_queries, evidence_queries, inquiry_queries, pivot_queries, result_queries, status_queries

_PARTS = (pivot_queries, status_queries, evidence_queries, inquiry_queries, binding_queries, result_queries)
QUERIES: dict = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
