"""All registered queries of the engine and their SQL counterparts."""

from __future__ import annotations

from . import compare, history, models, text  # noqa: F401
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
