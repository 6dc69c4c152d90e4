"""Queries and SQL of the rebuilt conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperlake.llm import conversations as C
from paperlake.session import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return C.faults(table(spark, d, "conversations"), table(spark, d, "messages"))


def p5_turns(spark: SparkSession, d: str) -> DataFrame:
    return C.rebuilt(table(spark, d, "conversations"), table(spark, d, "messages"))


QUERIES = {"p5_found": p5_found, "p5_turns": p5_turns}

_INV = C.INVISIBLE
_SPACE = f"[\\s\\p{{Z}}\\p{{C}}{_INV}]"
_in = lambda roles: ", ".join(f"'{r}'" for r in roles)
_BASE = f"""
WITH m0 AS (SELECT id, conversation_id, "timestamp" ts, content, loaded_at,
  regexp_replace(lower(role), '[^a-z]', '', 'g') r,
  lower(regexp_replace(content, '^{_SPACE}+|{_SPACE}+$', '', 'g')) t FROM messages
  QUALIFY id IS NULL OR row_number() OVER (PARTITION BY id ORDER BY loaded_at NULLS LAST) = 1),
m AS (SELECT id, conversation_id, ts, content,
  CASE WHEN r IN ({_in(C.USER_ROLES)}) THEN CASE WHEN coalesce(t, '') = '' THEN 'b' ELSE 'u' END
  WHEN r IN ({_in(C.SYSTEM_ROLES)}) THEN 'x'
  WHEN r IN ({_in(C.ASSISTANT_ROLES)}) THEN CASE WHEN coalesce(t, '') = ''
    OR regexp_matches(t, '^[\\p{{P}}\\p{{S}}]*(?:{C.PLACEHOLDERS})?[\\p{{P}}\\p{{S}}]*$')
    OR (NOT contains(t, chr(10) || chr(10))
      AND regexp_matches(t, '^(?:[^\\p{{L}}\\p{{N}}\\[]*)(?:{C.ERROR_STARTS})')) THEN 'x' ELSE 'a' END
  ELSE '?' END k FROM m0 WHERE conversation_id IS NOT NULL),
o AS (SELECT *, lag(k) OVER w p, lead(k) OVER w n FROM m WHERE k IN ('u', 'b', 'a') AND ts IS NOT NULL
  WINDOW w AS (PARTITION BY conversation_id ORDER BY ts, CASE k WHEN 'a' THEN 1 ELSE 0 END, id)),
b AS (SELECT conversation_id, bool_or(k = 'a' AND coalesce(p, '') NOT IN ('u', 'b')) broken,
  bool_or(k <> 'a' AND coalesce(n, '') <> 'a') silent FROM o GROUP BY 1),
f AS (SELECT conversation_id, count(*) FILTER (k IN ('u', 'a')) said,
  count(*) FILTER (k IN ('?', 'b') OR ts IS NULL) bad FROM m GROUP BY 1),
g AS (SELECT id AS conversation_id, CASE WHEN coalesce(said, 0) = 0 THEN 'empty'
  WHEN bad > 0 OR coalesce(broken, false) THEN 'broken' WHEN coalesce(silent, false) THEN 'no_reply' END fault
 FROM (SELECT DISTINCT id FROM conversations WHERE id IS NOT NULL) c
 LEFT JOIN f ON f.conversation_id = c.id LEFT JOIN b ON b.conversation_id = c.id)
"""
SQL = {
    "p5_found": _BASE + "SELECT conversation_id, fault FROM g WHERE fault IS NOT NULL",
    "p5_turns": _BASE
    + """SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY ts,
  CASE k WHEN 'a' THEN 1 ELSE 0 END, id NULLS LAST, content) AS turn,
  CASE k WHEN 'u' THEN 'user' ELSE 'assistant' END AS speaker, epoch_us(ts) AS ts, content
FROM m WHERE k IN ('u', 'a') AND conversation_id IN (SELECT conversation_id FROM g WHERE fault IS NULL)""",
}
