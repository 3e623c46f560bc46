"""All queries of the core."""

from __future__ import annotations

from loomspark.plans import general, knowledge, lifecycle, retrieval

_MODULES = (retrieval, knowledge, lifecycle, general)

QUERIES: dict = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL: dict = {k: q for m in _MODULES for k, q in m.SQL.items()}
