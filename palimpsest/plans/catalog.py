"""The registry of the library's own queries: name to callable, and name to the SQL that it equals."""

from __future__ import annotations

from . import map_queries, recall_queries, report_queries, session_queries, telemetry_queries, temporal_queries, text_queries

_PARTS = (temporal_queries, session_queries, text_queries, recall_queries, telemetry_queries, report_queries, map_queries)
QUERIES = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
SQL = {k: s for part in _PARTS for k, s in part.SQL.items()}
