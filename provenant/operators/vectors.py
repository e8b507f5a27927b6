"""Exact nearest chunks for a table of queries, by blocks with ball bounds.

Vectors are packed into blocks inside the tasks that read them: a block holds similar vectors of one batch up to a budget of bytes, with their
centre and the largest angle to it. Queries are packed too. A pack meets every block; the angle between query and centre, less the
block's radius, bounds the cosine of all its vectors, so a block is scored only for queries whose current n-th score it can reach.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from provenant.plans.skew import top_per_group
from provenant.settings import Settings

# Scores are rounded before ranking, so equal vectors tie wherever they were scored.
SCORE_DIGITS = 9
#: Packs whose best hits a task holds at once.
PACKS_HELD = 8
#: Added to angles, which arc cosines give only roughly.
ANGLE_SLACK = 1e-6

_QUERY_COLUMNS = ["query_id", "embedding", "language", "act_ids", "as_of"]
_CHUNK_COLUMNS = ["chunk_id", "embedding", "language", "act_id", "effective_from", "effective_to"]


class _Block:
    """A bounded block of queries as one matrix, and the scopes of its rows."""

    def __init__(self, rows: dict[str, list]):
        self.ids = np.array(rows["query_id"])
        self.matrix = rows["embedding"]
        self.languages = _objects(rows.get("language"))
        self.scopes = [s if s is not None and len(s) else None for s in rows.get("act_ids", [])]
        self.days = _days(rows.get("as_of"))

    def scores(self, batch: dict, some: np.ndarray) -> np.ndarray:
        """Scores of some queries; minus infinity out of scope."""
        # Adding 0.0 turns -0.0 into 0.0, which would order differently.
        scores = np.round(self.matrix[some] @ batch["embedding"].T, SCORE_DIGITS) + 0.0
        allowed = np.isfinite(scores)
        if self.languages is not None and "language" in batch:
            allowed &= self.languages[some, None] == batch["language"][None, :]
        if self.days is not None and "effective_from" in batch:
            allowed &= batch["effective_from"][None, :] <= self.days[some, None]
            allowed &= batch["effective_to"][None, :] >= self.days[some, None]
        if "act_id" in batch:
            for row, i in enumerate(some.tolist()):
                if self.scopes and self.scopes[i] is not None:
                    allowed[row] &= np.isin(batch["act_id"], list(self.scopes[i]))
        return np.where(allowed, scores, -np.inf)


class _Best:
    """The n best chunks so far per query of a pack, ties to the smaller chunk id."""

    def __init__(self, block: _Block, n: int):
        self.block, self.n = block, n
        self.rows = pd.DataFrame({"q": np.array([], np.int64), "chunk_id": [], "score": np.array([], float)})
        self.floors = np.full(len(block.ids), -np.inf)
        self.scored = self.skipped = 0

    def add(self, batch: dict) -> None:
        if batch["centre"].shape[0] != self.block.matrix.shape[1]:
            raise ValueError(f"queries have {self.block.matrix.shape[1]} dimensions, chunks {batch['centre'].shape[0]}")
        angles = np.arccos(np.clip(self.block.matrix @ batch["centre"], -1, 1))
        reach = np.cos(np.maximum(0, angles - batch["radius"] - ANGLE_SLACK))
        some = np.flatnonzero(reach >= self.floors)
        self.skipped += len(reach) - len(some)
        self.scored += len(some)
        if not len(some):
            return
        scores, ids, n = self.block.scores(batch, some), batch["chunk_id"], self.n
        keep = np.isfinite(scores) & (scores >= self.floors[some, None])
        if scores.shape[1] > n:
            floor = np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]
            keep &= scores >= floor[:, None]
        q, c = np.nonzero(keep)
        if not len(q):
            return
        fresh = pd.DataFrame({"q": some[q], "chunk_id": ids[c], "score": scores[q, c]})
        merged = pd.concat([self.rows, fresh]) if len(self.rows) else fresh
        merged = merged.sort_values(["q", "score", "chunk_id"], ascending=[True, False, True])
        self.rows = merged.groupby("q", sort=False).head(n)
        last = self.rows.groupby("q")["score"].agg(["size", "min"])
        full = last[last["size"] == n]
        self.floors[full.index.to_numpy()] = full["min"].to_numpy()

    def result(self, kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(self.block.ids[self.rows["q"].to_numpy()], kinds["query_id"]),
             pa.array(self.rows["chunk_id"].to_numpy(), kinds["chunk_id"]), pa.array(self.rows["score"].to_numpy(), pa.float64())],
            names=["query_id", "chunk_id", "score"])


def _unit(matrix: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return matrix / norm


def _objects(values: list | None) -> np.ndarray | None:
    return None if values is None else np.array(values, dtype=object)


def _days(values: list | None, missing: int | None = None) -> np.ndarray | None:
    if values is None:
        return None
    days = pd.to_datetime(pd.Series(values, dtype="object")).to_numpy("datetime64[D]").astype(np.int64)
    nat = np.iinfo(np.int64).min
    return np.where(days == nat, nat if missing is None else missing, days)


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) % max(len(column), 1):
        raise ValueError("embeddings of different dimensions in one table")
    return _unit(flat.reshape(len(column), -1))


def _lists(values: pa.Array, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)


def _pack(batch: pa.RecordBatch, order: np.ndarray, bounds: np.ndarray, unit: np.ndarray) -> dict[str, pa.Array]:
    """Rows of a batch as lists, one per block; vectors flat."""
    rows, out = pa.array(order), {}
    for name in batch.schema.names:
        if name == "embedding":
            out[name] = _lists(pa.array(unit[order].reshape(-1)), bounds * unit.shape[1])
        else:
            out[name] = _lists(batch.column(name).take(rows), bounds)
    return out


def _packed_type(rows: DataFrame, *more: tuple[str, T.DataType]) -> T.StructType:
    fields = [T.StructField(f.name, T.ArrayType(T.DoubleType() if f.name == "embedding" else f.dataType)) for f in rows.schema]
    return T.StructType(fields + [T.StructField(name, kind) for name, kind in more])


def cells_of(unit: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows and the borders of cells of at most ``size`` similar rows in it."""
    k = -(-len(unit) // size)
    # The rows at equal distances are as good as random ones; a batch has no order by similarity.
    nearest = (unit @ unit[np.arange(k) * len(unit) // k].T).argmax(axis=1)
    order = np.argsort(nearest, kind="stable")
    groups = np.append(0, np.cumsum(np.bincount(nearest, minlength=k)))
    borders = np.unique(np.concatenate([np.arange(a, b, size) for a, b in zip(groups, groups[1:]) if b > a] + [[len(unit)]]))
    return order, borders.astype(np.int64)


def ball(unit: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre and largest angle to it."""
    centre = unit.sum(axis=0)
    length = np.linalg.norm(centre)
    centre = centre / length if length > 0 else unit[0]
    return centre, float(np.arccos(np.clip(unit @ centre, -1, 1)).max())


def blocks_of(chunks: DataFrame, cell_bytes: int) -> DataFrame:
    """Chunks as blocks: lists of their columns, unit vectors, centre and radius."""
    rows = _scored(chunks, _CHUNK_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _vectors(batch.column("embedding"))
                order, bounds = cells_of(unit, max(1, cell_bytes // (8 * unit.shape[1])))
                balls = [ball(unit[order[a:b]]) for a, b in zip(bounds, bounds[1:])]
                out = _pack(batch, order, bounds, unit)
                yield pa.RecordBatch.from_arrays([*out.values(), pa.array([c for c, _ in balls], pa.list_(pa.float64())), pa.array([r for _, r in balls])],
                                                 names=[*out, "centre", "radius"])

    return rows.mapInArrow(run, _packed_type(rows, ("centre", T.ArrayType(T.DoubleType())), ("radius", T.DoubleType())))


def packs_of(queries: DataFrame, rows_in_pack: int) -> DataFrame:
    """Queries as packs of at most so many, with a number."""
    rows = _scored(queries, _QUERY_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            if batch.num_rows:
                bounds = np.append(np.arange(0, batch.num_rows, rows_in_pack), batch.num_rows)
                out = _pack(batch, np.arange(batch.num_rows), bounds, _vectors(batch.column("embedding")))
                yield pa.RecordBatch.from_arrays([*out.values(), pa.array(np.arange(len(bounds) - 1) + number)], names=[*out, "pack"])
                number += len(bounds) - 1

    return rows.mapInArrow(run, _packed_type(rows, ("pack", T.LongType())))


def _query_block(row: dict) -> _Block:
    rows = {name: values for name, values in row.items() if name in _QUERY_COLUMNS}
    return _Block(rows | {"embedding": np.array(row["embedding"]).reshape(len(row["query_id"]), -1)})


def chunk_block(columns: dict[str, pa.Array]) -> dict:
    """The columns of one block as the arrays that scoring takes."""
    out: dict = {"chunk_id": columns["chunk_id"].to_numpy(zero_copy_only=False)}
    for name, column in columns.items():
        if name == "embedding":
            out[name] = column.to_numpy(zero_copy_only=False).reshape(len(out["chunk_id"]), -1)
        elif name in ("effective_from", "effective_to"):
            out[name] = _days(column.to_pylist(), np.iinfo(np.int64).max if name == "effective_to" else None)
        elif name in ("language", "act_id"):
            out[name] = _objects(column.to_pylist())
    return out


def _scored(rows: DataFrame, columns: list[str], like: str = "embedding") -> DataFrame:
    names = [c for c in columns if c in rows.columns]
    nonzero = F.exists(like, lambda x: x != 0)
    return rows.select(*names).filter(F.col(like).isNotNull() & nonzero)


def vector_topn(queries: DataFrame, chunks: DataFrame, n: int, settings: Settings = Settings()) -> DataFrame:
    """(query_id, chunk_id, score, rank): the n nearest chunks by cosine, exactly.

    queries: query_id, embedding and optionally language, act_ids, as_of. chunks: chunk_id,
    embedding and optionally language, act_id, effective_from, effective_to. Filters apply
    before the cut. Null and zero vectors have no cosine and never match.

    One plan for any number of rows: packs of queries go to ``chunk_columns`` columns of blocks, or, where Spark finds them small
    enough, to every task. Tasks emit only the n best per query of what they met.
    """
    packs, blocks = packs_of(queries, settings.query_block_rows), blocks_of(chunks, settings.cell_bytes)
    names = {"query": [c for c in packs.columns if c != "pack"], "chunk": [c for c in blocks.columns if c not in ("centre", "radius")]}
    columns = settings.chunk_columns
    left = packs.select("pack", *[F.col(c).alias(f"q_{c}") for c in names["query"]]).withColumn("_column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    right = blocks.withColumn("_column", F.pmod(F.xxhash64("centre", "radius", "chunk_id"), F.lit(columns)).cast("int"))
    met = right.join(left, "_column").drop("_column")
    ids = (queries.schema["query_id"].dataType.simpleString(), chunks.schema["chunk_id"].dataType.simpleString())

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, _Best] = OrderedDict()
        kinds: dict[str, pa.DataType] = {}
        for batch in batches:
            kinds = {"query_id": batch.schema.field("q_query_id").type.value_type, "chunk_id": batch.schema.field("chunk_id").type.value_type}
            for i in range(batch.num_rows):
                pack = batch.column("pack")[i].as_py()
                if pack not in held:
                    # What was found so far is final for this task's share; the packs' later blocks are ranked with it at the end.
                    if len(held) == PACKS_HELD:
                        yield held.popitem(last=False)[1].result(kinds)
                    held[pack] = _Best(_query_block({c: batch.column(f"q_{c}")[i].as_py() for c in names["query"]}), n)
                held.move_to_end(pack)
                block = chunk_block({c: batch.column(c)[i].values for c in names["chunk"]})
                held[pack].add(block | {"centre": np.array(batch.column("centre")[i].as_py()), "radius": batch.column("radius")[i].as_py()})
        for found in held.values():
            yield found.result(kinds)

    local = met.mapInArrow(best, f"query_id {ids[0]}, chunk_id {ids[1]}, score double")
    return top_per_group(local, ["query_id"], [F.desc("score"), F.asc("chunk_id")], n)


def scoped(pairs: DataFrame, query, chunk, query_columns: list[str], chunk_columns: list[str]) -> DataFrame:
    """Keep pairs within the query's language, acts and date, as far as both sides carry them."""
    if "language" in query_columns and "language" in chunk_columns:
        pairs = pairs.filter(query("language") == chunk("language"))
    if "act_ids" in query_columns and "act_id" in chunk_columns:
        pairs = pairs.filter((F.coalesce(F.size(query("act_ids")), F.lit(0)) <= 0)
                             | F.array_contains(query("act_ids"), chunk("act_id")))
    if "as_of" in query_columns and "effective_from" in chunk_columns:
        pairs = pairs.filter((chunk("effective_from") <= query("as_of")) & (
            chunk("effective_to").isNull() | (chunk("effective_to") >= query("as_of"))))
    return pairs
