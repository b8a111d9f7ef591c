"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from . import queries_flow, queries_source, queries_table, queries_text

_MODULES = (queries_table, queries_flow, queries_text, queries_source)
QUERIES: dict = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLES: dict = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
