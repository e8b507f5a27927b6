"""Golden sets and the log of evaluation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from provenant import schemas

_TEXT_GOLDEN = T.StructType([
    T.StructField(f.name, T.StringType() if f.name == "as_of_date" else f.dataType)
    for f in schemas.GOLDEN.fields])

RUN_COLUMNS = ["run_id", "timestamp", "prompt_version", "reranker_version", "retrieval_config",
               "metrics", "record_count"]


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank lines are skipped, flags default to false."""
    rows = spark.read.schema(_TEXT_GOLDEN).json(path)
    return rows.withColumns({
        "must_cite": F.coalesce("must_cite", F.lit(False)),
        "should_decline": F.coalesce("should_decline", F.lit(False)),
        "as_of_date": F.to_date(F.nullif("as_of_date", F.lit("")))})


def write_golden(golden: DataFrame, path: str) -> None:
    golden.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_run(runs: DataFrame, path: str) -> None:
    runs.select(*RUN_COLUMNS).write.mode("append").parquet(path)


def latest_runs(runs: DataFrame, exclude: str | None = None) -> DataFrame:
    """The newest run of every prompt version, ignoring one run id."""
    if exclude is not None:
        runs = runs.filter(F.col("run_id") != exclude)
    newest = Window.partitionBy("prompt_version").orderBy(F.desc("timestamp"), F.desc("run_id"))
    return runs.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def latest_run(runs: DataFrame, version: str, exclude: str | None = None) -> DataFrame:
    return latest_runs(runs.filter(F.col("prompt_version") == version), exclude)
