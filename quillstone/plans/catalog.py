"""Registry of the engine's queries and of the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstone.plans import extract, search

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-round hybrid retrieval for every benchmark question."""
    return search.two_round_retrieve(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {**search.QUERIES, **extract.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**search.ORACLES, **extract.ORACLES}
