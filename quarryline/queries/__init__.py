"""Queries by operator number, and their SQL.  Each module registers its own."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def register(name: str, sql: str | None = None):
    """Enters a query, with SQL for DuckDB where SQL can express it."""

    def enter(query):
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = query
        if sql:
            ORACLE_SQL[name] = sql
        return query

    return enter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """SQL that both engines read alike, over the driver's tables."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            table(spark, sf_dir, name).createOrReplaceTempView(f"ql_{name}")
            sql = re.sub(rf"(FROM|JOIN|,) {name}\b", rf"\1 ql_{name}", sql)
    return spark.sql(sql)


from . import evaluation, layouts, more, outline, runtime, searches, sensing, texts  # noqa: E402, F401

flagship = searches.flagship
