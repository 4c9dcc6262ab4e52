"""Registered queries of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.plans import context_queries, library_queries, listing_queries, more_queries, question_queries, reader_queries, stored_queries, text_queries, write_queries

_PARTS = (library_queries.R, text_queries.R, more_queries.R, question_queries.R, listing_queries.R, write_queries.R, context_queries.R, reader_queries.R, stored_queries.R)
QUERIES = {name: f for part in _PARTS for name, f in part.queries.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.oracles.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search over documents, their chunks and vectors."""
    return text_queries.ret27_hybrid_search(spark, sf_dir)
