"""Registered queries over the driver's tables and the SQL that DuckDB runs beside them."""

from __future__ import annotations

from meridian.plans import decisions, evaluation, history, learning, linkage, profiling, shaping  # noqa: F401 - they register their queries
from meridian.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
