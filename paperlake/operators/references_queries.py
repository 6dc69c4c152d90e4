"""Queries and SQL of the orphan references."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperlake.operators import references as R
from paperlake.session import table


def _graph(spark: SparkSession, d: str) -> R.Graph:
    return R.chat_graph(*(table(spark, d, t) for t in ("messages", "conversations", "sessions", "kb_metadata")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return R.direct(_graph(spark, d)).drop("at")


def p4_cascade(spark: SparkSession, d: str) -> DataFrame:
    return R.cascade(_graph(spark, d)).select("child_table", "fk_field", "row_id", "kind", "depth")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return R.report(R.cascade(_graph(spark, d)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p4_found": p4_found,
    "p4_cascade": p4_cascade,
    "p4_report": p4_report,
}

_BASE = """
WITH s AS (SELECT id, min(loaded_at) l, min(deleted_at) d FROM sessions WHERE id IS NOT NULL GROUP BY id),
k AS (SELECT name id, min(loaded_at) l, min(deleted_at) d FROM kb_metadata WHERE name IS NOT NULL GROUP BY name),
c AS (SELECT id, min(loaded_at) l, min(deleted_at) d, arg_min(created_at, loaded_at) tm,
 arg_min(session_id, loaded_at) session_id, arg_min(kb_name, loaded_at) kb_name
 FROM conversations WHERE id IS NOT NULL GROUP BY id),
m AS (SELECT id, min(loaded_at) l, arg_min("timestamp", loaded_at) tm, arg_min(conversation_id, loaded_at) conversation_id
 FROM messages WHERE id IS NOT NULL GROUP BY id),
e AS (
 SELECT 'conversations' child_table, 'session_id' fk_field, c.id row_id, c.tm, s.id pid,
  CASE WHEN s.id IS NULL THEN 'missing' WHEN s.d <= c.tm THEN 'deleted' WHEN s.l > c.l THEN 'late' END state
 FROM c LEFT JOIN s ON c.session_id = s.id WHERE c.session_id IS NOT NULL
 UNION ALL
 SELECT 'conversations', 'kb_name', c.id, c.tm, k.id,
  CASE WHEN k.id IS NULL THEN 'missing' WHEN k.d <= c.tm THEN 'deleted' WHEN k.l > c.l THEN 'late' END
 FROM c LEFT JOIN k ON c.kb_name = k.id WHERE c.kb_name IS NOT NULL
 UNION ALL
 SELECT 'messages', 'conversation_id', m.id, m.tm, c.id,
  CASE WHEN c.id IS NULL THEN 'missing' WHEN c.d <= m.tm THEN 'deleted' WHEN c.l > m.l THEN 'late' END
 FROM m LEFT JOIN c ON m.conversation_id = c.id WHERE m.conversation_id IS NOT NULL),
a AS (
 SELECT child_table, fk_field, row_id, tm, state, 'direct' kind, 0 depth FROM e WHERE state IS NOT NULL
 UNION ALL
 SELECT child_table, fk_field, row_id, tm, 'inherited', 'inherited', 1 FROM e WHERE state IS NULL
 AND child_table = 'messages'
 AND pid IN (SELECT row_id FROM e WHERE child_table = 'conversations' AND state IS NOT NULL))
"""

SQL = {
    "p4_found": _BASE + "SELECT child_table, fk_field, row_id, state FROM e WHERE state IS NOT NULL",
    "p4_cascade": _BASE + "SELECT child_table, fk_field, row_id, kind, depth FROM a",
    "p4_report": _BASE
    + """SELECT child_table, fk_field, strftime(tm, '%Y-%m') AS "month", kind, state, count(*) AS n
FROM a GROUP BY ALL""",
}
