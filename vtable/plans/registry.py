"""Named queries over a folder of Parquet tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import engine_queries, kernel_queries, relational_queries, stream_queries

QUERIES = kernel_queries.QUERIES | engine_queries.QUERIES | relational_queries.QUERIES | stream_queries.QUERIES
ORACLE: dict[str, str] = kernel_queries.ORACLE | engine_queries.ORACLE | relational_queries.ORACLE | stream_queries.ORACLE


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live rows of a change log: events by user, newest event wins, errors are deletes."""
    return QUERIES["snapshot_latest"](spark, sf_dir)
