"""All queries of the core library with their SQL, gathered from the modules beside this one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_data, queries_reports, queries_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (queries_text, queries_reports, queries_data):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
