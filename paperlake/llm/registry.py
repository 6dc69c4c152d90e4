"""All queries of the subpackage and their SQL."""

from __future__ import annotations

from paperlake.llm import conversations_queries, persons_queries, records_queries, spans_queries, tokens_queries

_MODULES = (persons_queries, records_queries, conversations_queries, tokens_queries, spans_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
