"""Registry of the library's own queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auralake.functions import text  # noqa: F401
from auralake.operators import alerts, analytics, dataset, decision, evaluation, events, export, learning, neardup, sequences, signals  # noqa: F401
from auralake.plans.registry import QUERIES, SQL
from auralake.sources import files, versions  # noqa: F401
from auralake.streaming import jobs, messages  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["decision_overview_by_class"](spark, sf_dir)
