"""All queries of the library and their SQL."""

from __future__ import annotations

from . import catalogue, policies, scenes, timelines  # noqa: F401  they register themselves
from .base import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
