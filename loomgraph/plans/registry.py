"""All queries of the library and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.plans import answer_queries, evaluation_queries, event_queries, file_queries, graph_queries, ingest_queries, source_queries, text_queries

MODULES = (graph_queries, text_queries, evaluation_queries, event_queries, answer_queries, ingest_queries, source_queries, file_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest events to each nation over three hops, ranked."""
    return graph_queries.k1_top_events(spark, sf_dir)
