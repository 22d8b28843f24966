"""The registered queries of the core engine and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import cascades, curation, documents, exports, items, knowledge, records, relational, review, semantics, sources, texts  # noqa: F401  they register their queries
from .registry import ORACLE_SQL, QUERIES, Tables

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which works meet in the same manuscripts: co-occurrence of parts in orders."""
    return knowledge.cooccurrence(Tables(spark, sf_dir))
