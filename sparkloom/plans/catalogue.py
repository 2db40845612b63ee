"""Every query by name, and its SQL counterpart where SQL can express it."""

from __future__ import annotations

from sparkloom.plans import axis_queries, evaluation_queries, event_queries, graph_queries, label_queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (axis_queries, label_queries, graph_queries, event_queries, evaluation_queries):
    QUERIES.update(_part.QUERIES)
    ORACLE_SQL.update(_part.ORACLE_SQL)
