"""All core queries and their SQL."""

from __future__ import annotations

import importlib

_NAMES = ["text_queries", "unit_queries", "nested_queries", "stat_queries", "document_queries", "graph_queries", "match_queries", "label_queries", "run_queries", "judge_queries", "io_queries"]
_MODULES = [importlib.import_module(f"clauseloom.plans.{n}") for n in _NAMES]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in _MODULES for k, s in getattr(m, "ORACLE_SQL", {}).items()}
FLAGSHIP = QUERIES["clause_profile"]
