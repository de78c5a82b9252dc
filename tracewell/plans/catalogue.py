"""All queries by name, with the SQL that must give the same rows."""

from __future__ import annotations

from . import code_queries, diagnosis_queries, etl_queries, event_queries, function_queries, graph_queries, program_queries, retrieval_queries, triple_queries  # noqa: F401  they register
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
