"""The library's registered queries and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokenloom.plans import lexicon_queries, text_queries
from tokenloom.plans.registry import ORACLE, QUERIES

__all__ = ["flagship", "lexicon_queries", "oracle_sql", "queries", "text_queries"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of all tokens by language."""
    return text_queries.token_typing(spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
