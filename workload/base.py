"""Registration and loading."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from provenant.plans.session import configure, shared_folder, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = configure(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        return spread(self.spark.read.parquet(f"{self.folder}/{name}.parquet"))


def query(sql: str | None = None):
    """Register a function of Tables under its own name."""
    def register(build: Callable[[Tables], DataFrame]):
        name = build.__name__
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return build
    return register


def scratch(spark: SparkSession) -> str:
    """A new folder for tables that are written and read back."""
    return f"{shared_folder(spark)}/provenant-{uuid4().hex}"
