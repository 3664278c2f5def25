"""Registered queries of the core operators, with their SQL."""

from __future__ import annotations

from . import areas, facility, harmonise, reports, surveillance

MODULES = (facility, surveillance, harmonise, areas, reports)
QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLE_SQL = {k: q for m in MODULES for k, q in m.ORACLE_SQL.items()}
FLAGSHIP = "reporting_rate_combined"
