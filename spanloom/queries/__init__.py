"""Every operator as a query over the driver's tables, and its SQL where SQL can express it."""

from __future__ import annotations

from . import building, corpus, details, linking, scoring, spans, surface, texts

_MODULES = (texts, spans, scoring, linking, corpus, surface, building, details)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
