"""A stored inverted-file index of vectors, for approximate nearest chunks.

Cells are the Voronoi cells of centroids that spherical k-means finds on a bounded sample; every vector lies in the cell of its nearest
centroid, as an 8-bit code of its difference from it. A cell's codes are kept in blocks of bounded size, the vectors themselves in a table
of their own. A search probes each query's nearest cells, keeps a short list by the codes, and scores that list by the vectors.

    codes:   cell, chunk_id and scope columns as lists, codes binary, number of the block
    vectors: bucket, chunk_id, embedding

Null and zero vectors have no cosine; they are in no cell and never match.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from provenant.operators import vectors as V
from provenant.plans.session import shared_folder, stored
from provenant.plans.skew import salted_join, top_per_group
from provenant.settings import Settings

#: Vectors that k-means is fitted on, cells, and vectors in a block.
SAMPLE, CELLS, BLOCK_ROWS = 20_000, 64, 4096
LEVELS = 127
#: Scores of a block that a task holds at once.
SCORES = 1 << 18


@dataclass(frozen=True)
class VectorIndex:
    codes: DataFrame
    vectors: DataFrame
    centroids: np.ndarray
    scale: np.ndarray


def spherical_kmeans(unit: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most k unit centroids; the first ones lie evenly in the sample, an empty one goes to the row worst served."""
    centroids = unit[np.arange(min(k, len(unit))) * len(unit) // min(k, len(unit))].copy()
    for _ in range(rounds):
        scores = unit @ centroids.T
        nearest = scores.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, unit)
        lengths = np.linalg.norm(sums, axis=1)
        worst = iter(np.argsort(scores.max(axis=1), kind="stable"))
        for j, length in enumerate(lengths):
            centroids[j] = sums[j] / length if length > 1e-12 else unit[next(worst)]
    return centroids


def write_vector_index(chunks: DataFrame, cells: int = CELLS, sample: int = SAMPLE, folder: str | None = None, spread: int = 8) -> VectorIndex:
    """Fit cells on the ``sample`` vectors of least id hash; assign all vectors and write codes and vectors.

    The sample, at most ``sample`` vectors, is what the driver reads. ``spread`` files hold a cell's blocks per write, so that one cell may have
    a third of all vectors.
    """
    spark = chunks.sparkSession
    folder = folder or f"{shared_folder(spark)}/provenant-{uuid4().hex}"
    rows = V._scored(chunks, V._CHUNK_COLUMNS)
    drawn = rows.select("embedding", F.xxhash64("chunk_id").alias("_h")).orderBy("_h", "embedding").limit(sample).select("embedding").collect()
    if not drawn:
        none = V._packed_type(rows.drop("embedding"), ("codes", T.BinaryType()), ("cell", T.IntegerType()), ("block", T.LongType()))
        return VectorIndex(spark.createDataFrame([], none), rows.select("chunk_id", "embedding").limit(0), np.zeros((0, 0)), np.zeros(0))
    unit = V._unit(np.array([r.embedding for r in drawn], np.float64))
    centroids = spherical_kmeans(unit, cells)
    off = unit - centroids[(unit @ centroids.T).argmax(axis=1)]
    # Differences beyond those of the sample are cut off in the code; the short list is scored by the vectors.
    scale = np.maximum(np.abs(off).max(axis=0), 1e-9) / LEVELS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = V._vectors(batch.column("embedding"))
            cell = (unit @ centroids.T).argmax(axis=1)
            order = np.argsort(cell, kind="stable")
            codes = np.clip(np.rint((unit - centroids[cell]) / scale), -LEVELS, LEVELS).astype(np.int8)[order]
            ends = np.append(0, np.cumsum(np.bincount(cell, minlength=len(centroids))))
            bounds = np.unique(np.concatenate([np.arange(a, b, BLOCK_ROWS) for a, b in zip(ends, ends[1:]) if b > a] + [[len(unit)]])).astype(np.int64)
            out = V._pack(batch.drop_columns(["embedding"]), order, bounds, unit)
            yield pa.RecordBatch.from_arrays(
                [*out.values(), pa.array([codes[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()),
                 pa.array(cell[order][bounds[:-1]].astype(np.int32)), pa.array(np.arange(len(bounds) - 1) + number)], names=[*out, "codes", "cell", "block"])
            number += len(bounds) - 1

    schema = V._packed_type(rows.drop("embedding"), ("codes", T.BinaryType()), ("cell", T.IntegerType()), ("block", T.LongType()))
    packed = rows.mapInArrow(run, schema)
    packed.repartition(F.col("cell"), F.pmod(F.col("block"), F.lit(spread))).write.partitionBy("cell").parquet(f"{folder}/codes")
    rows.select("chunk_id", "embedding").write.parquet(f"{folder}/vectors")
    fields = [f for f in schema.fields if f.name != "cell"] + [schema["cell"]]
    return VectorIndex(spark.read.schema(T.StructType(fields)).parquet(f"{folder}/codes"), spark.read.schema(rows.select("chunk_id", "embedding").schema).parquet(f"{folder}/vectors"),
                       centroids, scale)


def probes_of(queries: DataFrame, index: VectorIndex, probes: int, rows_in_pack: int) -> DataFrame:
    """Packs of queries per cell that they probe: cell, and the queries' columns as lists."""
    rows, centroids = V._scored(queries, V._QUERY_COLUMNS), index.centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows_in_pack):
                batch = whole.slice(at, rows_in_pack)
                unit = V._vectors(batch.column("embedding"))
                if unit.shape[1] != centroids.shape[1]:
                    raise ValueError(f"queries have {unit.shape[1]} dimensions, chunks {centroids.shape[1]}")
                near = np.argsort(-(unit @ centroids.T), axis=1, kind="stable")[:, :probes]
                query, cell = np.repeat(np.arange(len(unit)), near.shape[1]), near.reshape(-1)
                order = np.argsort(cell, kind="stable")
                query, cell = query[order], cell[order]
                bounds = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell))
                out = V._pack(batch, query, bounds, unit)
                yield pa.RecordBatch.from_arrays([*out.values(), pa.array(cell[bounds[:-1]].astype(np.int32))], names=[*out, "cell"])

    return rows.mapInArrow(run, V._packed_type(rows, ("cell", T.IntegerType())))


def best_in_block(asked: V._Block, block: dict, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Queries, chunks and scores of the n best of a block for each query, by a few queries at a time: of at most ``SCORES`` scores, unless a block has more rows."""
    step = max(1, SCORES // max(1, len(block["chunk_id"])))
    for at in range(0, len(asked.ids), step):
        some = np.arange(at, min(at + step, len(asked.ids)))
        scores = asked.scores(block, some)
        keep = np.isfinite(scores)
        if scores.shape[1] > n:
            keep &= scores >= np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n, None]
        q, c = np.nonzero(keep)
        yield some[q], c, scores[q, c]


def short_lists(queries: DataFrame, index: VectorIndex, n: int, probes: int, settings: Settings) -> DataFrame:
    """(query_id, chunk_id): the n best of each query by the codes in the cells that it probes."""
    packs = probes_of(queries, index, probes, settings.query_block_rows)
    mine, theirs = [c for c in packs.columns if c != "cell"], [c for c in index.codes.columns if c not in ("cell", "block", "codes")]
    met = salted_join(index.codes, packs.select("cell", *[F.col(c).alias(f"q_{c}") for c in mine]), ["cell"], ["block"], settings.salts)
    centroids, scale = index.centroids, index.scale
    ids = (queries.schema["query_id"].dataType.simpleString(), index.vectors.schema["chunk_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked = V._query_block({c: batch.column(f"q_{c}")[i].as_py() for c in mine})
                centre = centroids[batch.column("cell")[i].as_py()]
                codes = np.frombuffer(batch.column("codes")[i].as_py(), np.int8).reshape(-1, len(centre))
                block = V.chunk_block({c: batch.column(c)[i].values for c in theirs}) | {"embedding": centre + codes * scale}
                for q, c, scores in best_in_block(asked, block, n):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(asked.ids[q], batch.schema.field("q_query_id").type.value_type), pa.array(block["chunk_id"][c], batch.schema.field("chunk_id").type.value_type),
                         pa.array(scores, pa.float64())], names=["query_id", "chunk_id", "score"])

    rough = met.mapInArrow(run, f"query_id {ids[0]}, chunk_id {ids[1]}, score double")
    return top_per_group(rough, ["query_id"], [F.desc("score"), F.asc("chunk_id")], n).select("query_id", "chunk_id")


def approximate_topn(queries: DataFrame, chunks: DataFrame, n: int, index: VectorIndex | None = None, probes: int = 44, shortlist: int = 4,
                     settings: Settings = Settings()) -> DataFrame:
    """As vector_topn, among the ``shortlist * n`` best by code of the ``probes`` nearest cells; exact scores.

    Vectors without clusters, such as random ones, need two thirds of the cells for a recall above 0.9, which is the default; clustered ones need
    far fewer. Scope columns apply before the cut. A query that finds fewer than n there is searched exactly in ``chunks``.
    """
    index = index or write_vector_index(chunks)
    if not len(index.centroids):
        return V.vector_topn(queries, chunks, n, settings)
    listed = short_lists(queries, index, shortlist * n, probes, settings)
    unit = lambda c: F.transform(c, lambda x: x.cast("double") / F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, y: a + y.cast("double") * y)))
    mine = V._scored(queries, ["query_id", "embedding"]).select("query_id", unit(F.col("embedding")).alias("_q"))
    pairs = listed.join(index.vectors, "chunk_id").withColumn("_c", unit(F.col("embedding"))).join(mine, "query_id")
    score = F.round(F.aggregate(F.zip_with("_q", "_c", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x), V.SCORE_DIGITS)
    found = stored(top_per_group(pairs.select("query_id", "chunk_id", score.alias("score")), ["query_id"], [F.desc("score"), F.asc("chunk_id")], n))
    whole = found.filter(F.col("rank") == n).select("query_id")
    rest = V.vector_topn(queries.join(whole, "query_id", "left_anti"), chunks, n, settings)
    return found.join(whole, "query_id", "left_semi").unionByName(rest)
