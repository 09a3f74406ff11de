"""Queries by name: each reads views over the tables of a folder; most have SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auralake.plans.views import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Views:
    """The tables of one folder and the domain views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        """A given table; zone-less timestamps become UTC timestamps."""
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        zoneless = {c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
        return df.withColumns(zoneless) if zoneless else df

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.table(name)
        tables, text = VIEWS[name]
        return self.spark.sql(text, **{t: getattr(self, t) for t in tables})


def _expanded(text: str) -> str:
    """The SQL with every {view} replaced by its definition over the plain tables."""
    for name, (tables, body) in VIEWS.items():
        if "{" + name + "}" in text:
            text = text.replace("{" + name + "}", f"({_expanded(body)})")
    text = text.replace("element_at(", "list_extract(")  # the name that DuckDB has for lists
    for name in _TABLES:
        text = text.replace("{" + name + "}", name)
    return text


_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def query(name: str, sql: str | None = None):
    """Register a function of Views as a query, with the SQL that gives the same rows."""

    def add(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, folder: f(Views(spark, folder))
        if sql:
            SQL[name] = _expanded(sql)
        return f

    return add
