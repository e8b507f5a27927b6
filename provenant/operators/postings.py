"""A stored positional inverted index over tokenised chunks.

Chunks are inverted batch by batch inside the tasks that read them, so no word's list is gathered in one place and nothing need be
shuffled. A block holds up to ``block`` postings of one word and language from one batch, those with the most
occurrences first, and states the most occurrences of any of them. Blocks lie in one folder per bucket of words; a search reads only the
buckets of its words, and of blocks it does not open only the head.

    blocks: bucket, term, language, segment, block, n, most, postings array<struct<chunk_id, scope columns, at array<int>>>
    terms:  bucket, term, df, most

A chunk whose tokens are null or empty has no postings. A chunk id that comes twice has postings twice: ids are unique.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from provenant.plans.session import shared_folder

#: Chunks that are inverted together.
SEGMENT = 4096
SCOPE = ["act_id", "effective_from", "effective_to"]


@dataclass(frozen=True)
class Index:
    blocks: DataFrame
    terms: DataFrame
    buckets: int

    def columns(self) -> list[str]:
        """Scope columns of the chunks, as a search may filter by them."""
        inner = self.blocks.schema["postings"].dataType.elementType.names
        return [c for c in SCOPE if c in inner] + (["language"] if "language" in self.blocks.columns else [])

    def of(self, used: list[int]) -> tuple[DataFrame, DataFrame]:
        """Blocks and terms of some buckets; the folders of others are not read."""
        wanted = F.col("bucket").isin(used)
        return self.blocks.filter(wanted), self.terms.filter(wanted)


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _cut(starts: np.ndarray, most: int) -> np.ndarray:
    """For sorted groups that begin at ``starts`` (and end at its last entry), where blocks of at most ``most`` begin."""
    sizes = np.diff(starts)
    blocks = -(-sizes // most)
    first = np.repeat(starts[:-1], blocks)
    within = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    return np.append(first + within * most, starts[-1])


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from the row before, the first row and the end included."""
    n = len(columns[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n + 1, bool)
    new[0] = new[n] = True
    for column in columns:
        new[1:n] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def invert(batch: pa.RecordBatch, inner: list[str], block: int, segment: int) -> pa.RecordBatch:
    """The postings of one batch of chunks as blocks."""
    tokens = batch.column("tokens")
    words = tokens.flatten().dictionary_encode()
    if words.null_count:
        raise ValueError("a token is null")
    sizes = np.where(np.asarray(tokens.is_valid()), np.nan_to_num(np.asarray(tokens.value_lengths().fill_null(0))), 0).astype(np.int64)
    chunk = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(chunk)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    code = np.asarray(words.indices).astype(np.int64)
    with_language = "language" in batch.schema.names
    spoken = batch.column("language").dictionary_encode("encode") if with_language else None
    language = np.asarray(spoken.indices).astype(np.int64) if with_language else np.zeros(len(sizes), np.int64)

    order = np.lexsort((place, chunk, code))
    code, chunk, place = code[order], chunk[order], place[order]
    starts = _changes(code, chunk)
    times = np.diff(starts)
    code, chunk = code[starts[:-1]], chunk[starts[:-1]]
    # Postings of a word and language, those with the most occurrences first.
    spoken_in = language[chunk]
    order = np.lexsort((chunk, -times, spoken_in, code))
    code, chunk, spoken_in, first, times = code[order], chunk[order], spoken_in[order], starts[:-1][order], times[order]
    ends = np.append(0, np.cumsum(times))
    at = pa.array(place[np.repeat(first - ends[:-1], times) + np.arange(ends[-1])].astype(np.int32))
    groups = _changes(code, spoken_in)
    heads = _cut(groups, block)
    number = np.arange(len(heads) - 1) - np.repeat(np.searchsorted(heads, groups[:-1]), -(-np.diff(groups) // block))
    rows = pa.array(chunk)
    fields = [batch.column(c).take(rows) for c in inner] + [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), at)]
    postings = pa.ListArray.from_arrays(pa.array(heads.astype(np.int32)), pa.StructArray.from_arrays(fields, names=[*inner, "at"]))
    lead = heads[:-1]
    out = {"term": words.dictionary.take(pa.array(code[lead])), "segment": pa.array(np.full(len(lead), segment)), "block": pa.array(number.astype(np.int32)),
           "n": pa.array(np.diff(heads).astype(np.int32)), "most": pa.array(times[lead].astype(np.int32)), "postings": postings}
    if with_language:
        out["language"] = spoken.dictionary.take(pa.array(spoken_in[lead]))
    return pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


def write_index(chunks: DataFrame, folder: str | None = None, buckets: int = 32, block: int = 128, spread: int | None = None) -> Index:
    """Invert chunks (chunk_id, tokens and optionally language, act_id, effective_from, effective_to) into two tables.

    Each task writes its blocks where they belong, a file per bucket, and nothing is shuffled. With ``spread``, blocks are shuffled
    so that so many files hold a bucket, for corpora read in very many tasks.
    """
    spark = chunks.sparkSession
    folder = folder or f"{shared_folder(spark)}/provenant-{uuid4().hex}"
    inner = ["chunk_id", *[c for c in SCOPE if c in chunks.columns]]
    lead = ["language"] if "language" in chunks.columns else []
    rows = chunks.select(*inner, *lead, "tokens").filter(F.size("tokens") > 0)
    posting = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in inner] + [T.StructField("at", T.ArrayType(T.IntegerType()))])
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("segment", T.LongType()), *[T.StructField(c, T.IntegerType()) for c in ("block", "n", "most")],
                           T.StructField("postings", T.ArrayType(posting)), *[T.StructField(c, rows.schema[c].dataType) for c in lead]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, batch in enumerate(batches):
            for j, at in enumerate(range(0, batch.num_rows, SEGMENT)):
                yield invert(batch.slice(at, SEGMENT), inner, block, (TaskContext.get().partitionId() << 32) + i * 64 + j)

    placed = rows.mapInArrow(run, schema).withColumn("bucket", bucket_of(F.col("term"), buckets))
    if spread:
        placed = placed.repartition(F.col("bucket"), F.pmod(F.col("segment"), F.lit(spread)))
    placed.sortWithinPartitions("bucket", "term", "segment", "block").write.partitionBy("bucket").parquet(f"{folder}/blocks")
    return read_index(spark, folder, buckets, schema, write_terms=True)


def read_index(spark: SparkSession, folder: str, buckets: int, schema: T.StructType | None = None, write_terms: bool = False) -> Index:
    reader = spark.read if schema is None else spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())]))
    blocks = reader.parquet(f"{folder}/blocks")
    if write_terms:
        blocks.groupBy("bucket", "term").agg(F.sum("n").alias("df"), F.max("most").alias("most")).repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/terms")
    terms = spark.read.schema("term string, df long, most int, bucket int").parquet(f"{folder}/terms")
    return Index(blocks, terms, buckets)
