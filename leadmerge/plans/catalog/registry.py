"""Registry of named queries and helpers they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leadmerge.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with its SQL text if it has one."""

    def add(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(Tables(prepare(spark), sf_dir))

        QUERIES[function.__name__] = run
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


class Tables:
    """Lazy access to the Parquet tables of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def text_time(c: Column) -> Column:
    """Instants as text, to compare engines without time zones."""
    return F.date_format(c.cast("timestamp"), "yyyy-MM-dd HH:mm:ss")


def joined(c: Column) -> Column:
    """Arrays as text."""
    return F.array_join(c, "|")
