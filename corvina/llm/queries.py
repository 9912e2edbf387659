"""The registered queries and SQL of this subpackage."""

from __future__ import annotations

from corvina.llm import encoding, neardup, ocr, packing, pairs, pii, percentiles, reading, splitting

MODULES = (splitting, ocr, pairs, pii, neardup, percentiles, encoding, packing, reading)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
