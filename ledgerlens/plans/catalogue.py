"""All queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from ledgerlens.plans import flow_queries, input_queries, narrative_queries, numeric_queries, plan_queries

_AREAS = (numeric_queries, narrative_queries, plan_queries, input_queries, flow_queries)
QUERIES = {k: v for area in _AREAS for k, v in area.QUERIES.items()}
SQL = {k: v for area in _AREAS for k, v in area.SQL.items()}
