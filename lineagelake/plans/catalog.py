"""All registered queries of the pedigree engine with their SQL."""

from __future__ import annotations

from lineagelake.plans import event_queries, incidence_queries, model_queries, pair_queries, pedigree_queries  # noqa: F401  they register
from lineagelake.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
