"""Queries over the sample tables, one module per part of the survey."""

from __future__ import annotations

from barloom.plans import batch, files, generation, indicators, patterns, reports, tables, trading
from barloom.plans.registry import ORACLES, QUERIES, Query

MODULES = (indicators, patterns, trading, reports, tables, files, batch, generation)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
