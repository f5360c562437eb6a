"""All queries of the engine itself, by name."""

from __future__ import annotations

from . import motion, scalars, series, signals, summaries

MODULES = (scalars, series, summaries, motion, signals)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
