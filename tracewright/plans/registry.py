"""All named queries over the driver's tables, with the SQL that DuckDB runs for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import corpus_queries, eventlog_queries, stats_queries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
for _part in (eventlog_queries, corpus_queries, stats_queries):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
