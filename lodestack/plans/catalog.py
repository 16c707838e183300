"""All queries of the core and their SQL."""

from __future__ import annotations

from lodestack.plans import q_joins, q_metrics, q_records, q_selection, q_text

_PARTS = (q_metrics, q_selection, q_joins, q_text, q_records)
QUERIES: dict = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
SQL: dict[str, str] = {k: s for p in _PARTS for k, s in p.SQL.items()}
