"""One query per operator, with SQL that computes the same."""

from __future__ import annotations

from . import image_queries, learning, tabular  # noqa: F401  they register their queries
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
