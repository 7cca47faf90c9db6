"""Every query of the library outside the llm package, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import frontier_queries, page_queries, text_queries
from .plans.base import QUERIES, SQL


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods of English documents with two words, filtered by length and ranked with a boost."""
    return text_queries.ranked_periods(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    assert frontier_queries and page_queries
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
