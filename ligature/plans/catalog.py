"""All queries of the library and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ligature.plans import frames, relational

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = relational.QUERIES | frames.QUERIES
ORACLE: dict[str, str] = relational.ORACLE | frames.ORACLE
