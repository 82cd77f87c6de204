"""Named queries over the driver tables, with an equivalent DuckDB statement where SQL has one."""

from __future__ import annotations

from . import color_queries, composite_queries, stat_queries, stencil_queries  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
