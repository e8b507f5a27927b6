"""The seven corpus tables as Parquet folders with explicit schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from provenant import schemas

PARTITIONS = {"provision_revisions": ["language"], "chunks": ["language"],
              "ingestion_runs": ["language"]}


class Corpus:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(schemas.TABLES[name]).parquet(self.path(name))

    def lookup(self, name: str, **keys) -> DataFrame:
        """Rows whose columns equal the given values; an unknown key gives no rows."""
        return lookup(self.table(name), **keys)

    def write(self, name: str, rows: DataFrame, mode: str = "overwrite") -> None:
        names = [f.name for f in schemas.TABLES[name].fields]
        writer = rows.select(*names).write.mode(mode)
        writer.partitionBy(*PARTITIONS.get(name, [])).parquet(self.path(name))


def lookup(rows: DataFrame, **keys) -> DataFrame:
    return rows.filter(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in keys.items()],
                              F.lit(True)))


def violations(name: str) -> Column:
    """Names of the columns whose value is outside their vocabulary."""
    failed = [F.when(~F.coalesce(F.col(column).isin(allowed), F.lit(False)), F.lit(column))
              for column, allowed in schemas.CHECKS.get(name, {}).items()]
    return F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")


def quarantine(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows that pass the checks, rows that fail with the failing columns)."""
    marked = rows.withColumn("violations", violations(name))
    return (marked.filter(F.size("violations") == 0).drop("violations"),
            marked.filter(F.size("violations") > 0))
