"""Provisions, revisions and chunks in Parquet folders by key bucket and batch, changed by appending.

A batch writes the folders ``bucket=b/batch=n`` of the buckets it touches and no others. What it ends (an open revision,
the former chunks of a revision) is a narrow row of a second table, applied when the table is read; texts that are
already stored are neither shuffled nor rewritten. A batch sees only the batches before it and overwrites its own
folders, so one that is repeated after a failure leaves the same rows. Batches are numbered upward from 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from provenant import schemas
from provenant.operators import revisions as rev
from provenant.plans.session import stored

BUCKETS = 64
#: Rows of a batch that one task writes to a bucket, about.
PART_ROWS = 20_000
_KEYS = ["provision_id", "language"]
_PLACE = [T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.LongType())]


def _ends(schema: T.StructType) -> T.StructType:
    """A closed revision: its id and batch, as an id comes again when a text returns on the same day."""
    return T.StructType([schema["provision_id"], schema["language"], T.StructField("id", T.StringType()),
                         T.StructField("closed_batch", T.LongType()), T.StructField("_closed", T.DateType())])



def _write(rows: DataFrame, path: str, keys: Sequence[str], batch: int, buckets: int) -> None:
    """Append by batch; a large bucket is split over several tasks and files."""
    placed = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    _append(placed.hint("rebalance", F.col("bucket")), path, batch)


def _append(placed: DataFrame, path: str, batch: int) -> None:
    placed.withColumn("batch", F.lit(batch).cast("long")).write.partitionBy("bucket", "batch").mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").parquet(path)


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, *_PLACE])).parquet(path)


def _begin(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """An empty folder of no batch, so that the table can be read before its first batch."""
    spark.createDataFrame([], schema).coalesce(1).write.mode("ignore").parquet(f"{path}/bucket=0/batch=-1")


def begin_revisions(spark: SparkSession, root: str, schema: T.StructType = schemas.REVISIONS) -> None:
    _begin(spark, f"{root}/versions", schema)
    _begin(spark, f"{root}/closings", _ends(schema))


def read_revisions(spark: SparkSession, root: str, schema: T.StructType = schemas.REVISIONS, before: int | None = None) -> DataFrame:
    """The revisions with their ends, as of all batches or those before one."""
    versions, ends = _read(spark, f"{root}/versions", schema), _read(spark, f"{root}/closings", _ends(schema))
    if before is not None:
        versions, ends = versions.filter(F.col("batch") < before), ends.filter(F.col("batch") < before)
    names = [c for c in versions.columns if c not in ("bucket", "batch")]
    ends = ends.select("bucket", "id", F.col("closed_batch").alias("batch"), "_closed")
    return versions.join(ends, ["bucket", "id", "batch"], "left").withColumn(
        "effective_to", F.coalesce("effective_to", "_closed")).select(*names)


def merge_revisions(spark: SparkSession, root: str, incoming: DataFrame, batch: int, schema: T.StructType = schemas.REVISIONS,
                    buckets: int = BUCKETS) -> DataFrame:
    """Merge a batch into the store as ``revisions.merge_revisions`` does; returns its outcomes.

    Of the store only the keys, hashes and days of open rows in the touched buckets are read. The batch is judged by the
    hashes of its texts, and read again for the texts of the revisions that it opens, so it must read the same twice. The list of touched
    buckets is the only thing that reaches the driver.
    """
    written = rev.hashed(incoming)
    batch_rows = stored(written.drop("text"))
    place = F.pmod(F.xxhash64(*_KEYS), F.lit(buckets)).cast("int")
    touched = [r[0] for r in batch_rows.select(place.alias("b")).distinct().collect()]
    past = lambda rows: rows.filter((F.col("batch") < batch) & F.col("bucket").isin(touched))
    ended = past(_read(spark, f"{root}/closings", _ends(schema))).select("bucket", "id", F.col("closed_batch").alias("batch"))
    heads = past(_read(spark, f"{root}/versions", schema)).filter("effective_to is null").select(
        *_KEYS, "bucket", "id", "batch", F.col("content_hash").alias("_hash"), F.col("effective_from").alias("_since"))
    heads = heads.join(ended, ["bucket", "id", "batch"], "left_anti").select(
        *_KEYS, "_hash", "_since", F.col("id").alias("_id"), F.col("batch").alias("_batch"))
    judged = stored(rev.judge(heads, batch_rows))
    names = [c for c in _read(spark, f"{root}/versions", schema).columns if c not in ("bucket", "batch")]
    opened, row = stored(rev.inserted(judged)), [*_KEYS, "fetched_at", "content_hash"]
    # Texts cross one shuffle: to their buckets, a large one in several parts, where the opened revisions meet them and repeated rows go.
    parts = max(1, opened.count() // (buckets * PART_ROWS))
    dealt = {"bucket": place, "_part": F.pmod(F.xxhash64(*row), F.lit(parts))}
    rest = F.struct(*[c for c in opened.columns if c not in row])
    both = written.select(*row, "text", F.lit(None).cast(opened.select(rest.alias("r")).schema["r"].dataType).alias("_r")).unionByName(
        opened.select(*row, F.lit(None).cast("string").alias("text"), rest.alias("_r")))
    met = both.withColumns(dealt).repartition("bucket", "_part").groupBy("bucket", "_part", *row).agg(
        F.first("text", ignorenulls=True).alias("text"), F.first("_r", ignorenulls=True).alias("_r")).filter("_r is not null")
    _append(met.select(*[F.col(f"_r.{c}") if c not in [*row, "text"] else F.col(c) for c in names], "bucket"), f"{root}/versions", batch)
    ends = rev.closing(judged, "_id", "_batch").select(*_KEYS, F.col("_id").alias("id"), F.col("_batch").alias("closed_batch"), "_closed")
    _write(ends, f"{root}/closings", _KEYS, batch, buckets)
    return rev.outcomes_of(judged)


def opened_revisions(spark: SparkSession, root: str, batch: int, schema: T.StructType = schemas.REVISIONS) -> DataFrame:
    """The revisions that a batch wrote and left open: the only ones to chunk."""
    return _read(spark, f"{root}/versions", schema).filter((F.col("batch") == batch) & F.col("effective_to").isNull()).drop("bucket", "batch")


def compact_revisions(spark: SparkSession, root: str, target: str, batch: int, schema: T.StructType = schemas.REVISIONS,
                      buckets: int = BUCKETS) -> None:
    """Write all batches before ``batch`` as one, with their ends applied, to a new folder that takes on from there."""
    begin_revisions(spark, target, schema)
    _write(read_revisions(spark, root, schema, batch), f"{target}/versions", _KEYS, batch - 1, buckets)


def begin_provisions(spark: SparkSession, root: str) -> None:
    _begin(spark, f"{root}/provisions", schemas.PROVISIONS)


def read_provisions(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """Each provision as the last batch that changed it wrote it, of all batches or those before one."""
    rows = _read(spark, f"{root}/provisions", schemas.PROVISIONS)
    if before is not None:
        rows = rows.filter(F.col("batch") < before)
    names = schemas.PROVISIONS.fieldNames()
    return rows.groupBy("act_id", "sort_path").agg(F.max_by(F.struct(*names), "batch").alias("_r")).select(*[F.col(f"_r.{c}").alias(c) for c in names])


def merge_provisions(spark: SparkSession, root: str, incoming: DataFrame, batch: int, buckets: int = BUCKETS) -> None:
    """Upsert as ``revisions.upsert_provisions`` does, by appending the provisions that are new or changed."""
    merged = rev.upsert_provisions(read_provisions(spark, root, batch), incoming)
    fresh = merged.filter(F.col("outcome").isin("inserted", "updated")).drop("outcome")
    _write(fresh, f"{root}/provisions", ["act_id", "sort_path"], batch, buckets)


def begin_chunks(spark: SparkSession, root: str, schema: T.StructType) -> None:
    """``schema`` holds a revision_id."""
    _begin(spark, f"{root}/chunks", schema)
    _begin(spark, f"{root}/replaced", _replaced(schema))


def _replaced(schema: T.StructType) -> T.StructType:
    return T.StructType([schema["revision_id"]])


def replace_chunks(fresh: DataFrame, root: str, batch: int, buckets: int = BUCKETS) -> None:
    """The chunks of the fresh rows' revisions give way to them as a whole."""
    fresh = stored(fresh)
    _write(fresh, f"{root}/chunks", ["revision_id"], batch, buckets)
    _write(fresh.select("revision_id").distinct(), f"{root}/replaced", ["revision_id"], batch, buckets)


def read_chunks(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The chunks of each revision from the last batch that wrote it."""
    chunks = _read(spark, f"{root}/chunks", schema)
    last = _read(spark, f"{root}/replaced", _replaced(schema)).groupBy("bucket", "revision_id").agg(F.max("batch").alias("batch"))
    return chunks.join(last, ["bucket", "revision_id", "batch"], "left_semi").select(
        *[c for c in chunks.columns if c not in ("bucket", "batch")])


def written_chunks(spark: SparkSession, root: str, schema: T.StructType, batch: int) -> DataFrame:
    """The chunks that a batch wrote."""
    return _read(spark, f"{root}/chunks", schema).filter(F.col("batch") == batch).drop("bucket", "batch")
