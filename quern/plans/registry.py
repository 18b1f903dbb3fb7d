"""All queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def load() -> None:
    """Import every module that registers queries."""
    from quern.plans import asked, catalog, chat, context, dates, folders, fusion, incremental, ingest, jobs, live, location, prompts, retrieval, routing, texts, threads, vectors  # noqa: F401


def entry(spark: SparkSession) -> DataFrame:
    """Hybrid retrieval over the smallest tables."""
    load()
    return QUERIES["hybrid_retrieve"](spark, "/root/testdata/sf0.001")
