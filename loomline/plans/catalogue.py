"""Named queries and their DuckDB oracles."""

from __future__ import annotations

from loomline.plans import assembly, audits, editing, evaluation, events, gates, observation, planning, reports, retrieval, rules, stores, streams, text, timeline, trend, wording

MODULES = (trend, timeline, events, assembly, gates, text, retrieval, evaluation, streams, wording, rules, editing, audits, planning, observation, stores, reports)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
