"""All core queries and their SQL."""

from __future__ import annotations

from paperlake.operators import references_queries
from paperlake.plans import retrieval_queries, table_queries, text_queries

_MODULES = (references_queries, text_queries, retrieval_queries, table_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
