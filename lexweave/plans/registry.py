"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from lexweave.plans import drift, experiments, orphans, ranking, relations, search, texts

FLAGSHIP = "bm25_topk"
_MODULES = (orphans, search, relations, ranking, texts, drift, experiments)

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
