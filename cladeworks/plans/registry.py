"""All queries on the driver's tables with their SQL counterparts."""

from __future__ import annotations

from . import analytics, checklists, facade, hierarchy, names, relational, taxonomy

_MODULES = (relational, analytics, hierarchy, names, checklists, facade, taxonomy)
QUERIES: dict = {}
SQL: dict[str, str] = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
FLAGSHIP = "q_children_counts"
