"""All registered queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideline.plans import container_queries, format_queries, timeline_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**timeline_queries.QUERIES, **container_queries.QUERIES, **format_queries.QUERIES}
SQL: dict[str, str] = {**timeline_queries.SQL, **container_queries.SQL, **format_queries.SQL}
