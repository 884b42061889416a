"""Registered queries of the research engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import market_queries, panel_queries, portfolio_queries, source_queries
from .base import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel, reversal factor, legs, overlapping holdings, costs, daily result."""
    return QUERIES["portfolio_net"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


__all__ = ["flagship", "oracle_sql", "market_queries", "panel_queries", "portfolio_queries", "queries", "source_queries"]
