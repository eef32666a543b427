"""The registered queries over the reference tables, with their SQL twins."""

from __future__ import annotations

from .plans import advice, clocks, dynamics, overview, predictive, quality

_GROUPS = (quality.query, dynamics.query, predictive.query, clocks.query, overview.query, advice.query)


def queries() -> dict:
    return {name: f for g in _GROUPS for name, f in g.queries.items()}


def oracle_sql() -> dict:
    return {name: text for g in _GROUPS for name, text in g.sql.items()}
