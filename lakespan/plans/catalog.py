"""All registered queries with their SQL."""

from __future__ import annotations

from . import detecting, result_queries, scoring_queries, text_queries

_MODULES = (detecting, scoring_queries, text_queries, result_queries)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.queries().items()}


def oracle_sql() -> dict:
    return {k: v for m in _MODULES for k, v in m.oracle_sql().items()}
