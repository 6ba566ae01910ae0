"""All queries of the core, and their SQL."""

from __future__ import annotations

from siltstone.plans import changes, documents, retrieval, scalars

MODULES = (scalars, retrieval, documents, changes)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
FLAGSHIP = "hybrid_topk"
