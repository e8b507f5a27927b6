"""Continuous ingest of page snapshots into a corpus folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

PAGES = ("page_id string, slug string, language string, url string, html string, "
         "fetched_at timestamp, not_modified boolean")


def page_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_ingest(pages: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """Writer that hands each micro-batch to ``merge``, usually ``plans.ingest.ingest_batch``, which parses,
    places, merges and chunks the pages of the batch and appends what they change to the stored corpus.

    Every fetch reaches the merge, which takes the fetches of a page in time order, drops repeats and reports those
    older than the open revision; nothing is dropped before it can be counted. ``merge`` gets the batch id: a batch
    repeated after a failure has the same id.
    """
    return pages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
