"""The registered queries (spark, folder of the tables) -> DataFrame, and the SQL of each that has one."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("transforms", "sources", "quality", "charts", "series", "features", "learning", "monitoring")

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _family in FAMILIES:
    _module = import_module(f"marlpit.queries.{_family}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
