"""Registered queries and their reference SQL."""

from __future__ import annotations

from nivalis.plans import q_grid, q_series, q_skill  # noqa: F401  (they register)
from nivalis.plans.registry import ORACLE, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
