"""All registered queries, gathered from the plan modules."""

from __future__ import annotations

from quillspark.plans import aggregates, ordering, registry, relational, retrieval, scalars, scans, state, usage  # noqa: F401  (plans register on import)

QUERIES = registry.QUERIES
ORACLE = registry.ORACLE
