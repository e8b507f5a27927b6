"""Session settings the jobs expect, and durable cuts of long lineages."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables that cut a lineage: the one the cluster names, else one in the session's warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (shared or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/provenant-tables").rstrip("/")


def stored(rows: DataFrame) -> DataFrame:
    """Write a frame that several branches read and read it back, so that it is computed once.

    The table is columnar, so each branch reads only its columns, and it outlives executors.
    """
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/provenant-{uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """Redistribute a scan that has fewer tasks than the session has cores.

    A large table already has many splits and is returned as it is; only a table in one small
    file would otherwise run its whole plan in one task.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
