"""Queries over the tables, by area."""

from __future__ import annotations

from tidewater.plans.registry import QUERIES, SQL, Query


def all_queries() -> dict[str, Query]:
    """Every query of the library but the training-data operators'."""
    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    """The SQL of the queries that SQL can express."""
    _load()
    return dict(SQL)


def _load() -> None:
    from tidewater.plans import io, listing, monitoring, rules, select, usage  # noqa: F401
