"""Registry of acts, one JSON record each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from provenant.functions.hashing import stable_id

REQUIRED = ["slug", "short_name", "full_name_en", "full_name_bn", "act_number", "act_year"]

REGISTRY = T.StructType(
    [T.StructField(c, T.IntegerType() if c == "act_year" else T.StringType()) for c in REQUIRED]
    + [T.StructField("ministry", T.StringType()), T.StructField("status", T.StringType()),
       T.StructField("sources", T.ArrayType(T.StructType([
           T.StructField("language", T.StringType()), T.StructField("source_url", T.StringType())])))])


def read_registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(acts, sources); reading a record without a required field is an error."""
    return registry(spark.read.schema(REGISTRY).option("mode", "PERMISSIVE").json(path))


def registry(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    missing = F.array_join(F.array_compact(F.array(
        *[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED])), ", ")
    # The check sits in the slug, which every consumer reads.
    slug = F.when(missing != "", F.raise_error(F.concat(
        F.lit("registry record lacks: "), missing)).cast("string")).otherwise(F.col("slug"))
    acts = records.select(
        stable_id(slug).alias("id"), slug.alias("slug"), *REQUIRED[1:], "ministry",
        F.coalesce("status", F.lit("in_force")).alias("status"))
    sources = records.select(slug.alias("slug"), F.explode("sources").alias("s")).select(
        "slug", "s.language", "s.source_url")
    return acts, sources
