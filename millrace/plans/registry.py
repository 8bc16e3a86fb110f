"""All queries over the driver's tables, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import catalog, conversation, records, relational, retrieval, rules, streams  # noqa: F401 - each adds its queries

FLAGSHIP = retrieval.e06_hybrid_search


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.ORACLES)
