"""All queries of the engine's own operators, by name, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from lakeloom.operators import admission, content, crawl, evidence, exploration, indexing, intake, linkage, operations, parsing, relational, retrieval, versioning
from lakeloom.streaming import counters

_MODULES = (relational, linkage, admission, crawl, intake, evidence, exploration, indexing, retrieval, operations, versioning, content, parsing, counters)
QUERIES: dict[str, Callable] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL: dict[str, str] = {k: f for m in _MODULES for k, f in m.SQL.items()}
