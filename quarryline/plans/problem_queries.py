"""Queries of the data-quality problems that are not about text."""

from __future__ import annotations

from quarryline.operators.orphans import orphan_references, orphan_report
from quarryline.session import table


def _orphans(spark, d):
    return orphan_references(table(spark, d, "chat_logs"), table(spark, d, "users"), table(spark, d, "feedback"))


def p2_found(spark, d):
    return _orphans(spark, d).select("child_table", "record_id", "ref_column", "reason").distinct()


def p2_report(spark, d):
    return orphan_report(_orphans(spark, d))


_ORPHANS = """
WITH refs AS (
  SELECT DISTINCT 'chat_logs' AS child_table, id AS record_id, 'user_id' AS ref_column, user_id AS k, created_at AS t FROM chat_logs
  UNION ALL SELECT DISTINCT 'feedback', id, 'user_id', user_id, created_at FROM feedback
  UNION ALL SELECT DISTINCT 'feedback', id, 'log_id', log_id, created_at FROM feedback),
parents AS (
  SELECT 'user_id' AS ref_column, user_id AS k, created_at AS a, deleted_at AS b FROM users
  UNION ALL SELECT DISTINCT 'log_id', id, created_at, CAST(NULL AS TIMESTAMP) FROM chat_logs),
judged AS (
  SELECT r.child_table, r.record_id, r.ref_column, r.t,
    CASE WHEN count(p.k) = 0 THEN 'missing'
         WHEN r.t IS NULL OR count(*) FILTER (WHERE p.a <= r.t AND (p.b IS NULL OR p.b > r.t)) > 0 THEN NULL
         WHEN count(*) FILTER (WHERE p.a > r.t) = count(p.k) THEN 'late' ELSE 'deleted' END AS reason
  FROM refs r LEFT JOIN parents p ON p.ref_column = r.ref_column AND p.k = r.k
  WHERE r.k IS NOT NULL GROUP BY r.child_table, r.record_id, r.ref_column, r.t)
"""

QUERIES = {"p2_found": p2_found, "p2_report": p2_report}
ORACLES = {
    "p2_found": _ORPHANS
    + "SELECT DISTINCT child_table, record_id, ref_column, reason FROM judged WHERE reason IS NOT NULL",
    "p2_report": _ORPHANS
    + "SELECT child_table, ref_column, strftime(t, '%Y-%m') AS month, reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY 1, 2, 3, 4",
}
