"""All queries of the core."""

from __future__ import annotations

from dsforge.plans import operator_queries, page_queries, quality_queries, row_queries  # noqa: F401  (registers its queries)
from dsforge.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
