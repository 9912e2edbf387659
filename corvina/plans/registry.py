"""Queries of the core, by name, with the SQL that must give the same rows."""

from __future__ import annotations

from corvina.plans import graphs, reports, search, texts
from corvina.streaming import incremental

MODULES: tuple = (search, texts, reports, graphs, incremental)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
