"""Centroid clustering with a table of distances to pivots (LAESA).

Vectors become integers, ``floor(scale * x)`` of each component, so that all distances, sums and centroids are exact. The
squared distance of each vector to a few fixed pivots is worked out once and written beside it. In every round a centroid's distances to the
pivots bound its distance to a vector from below, since the two differ by no more than the vector lies off the centroid. A vector
first gets the exact distance to the centroid of the least bound, then to those whose bound does not exceed it: squares of integers, compared exactly.
Bounds are lowered by more than their rounding error, so no nearest centroid is missed.

A round is one pass over the written table. Tasks return a count and sums per centroid, which Spark adds up; only these ``k``
rows reach the driver, and the centroids, ``k`` vectors, go out with the next pass. No row is moved. A hot centroid costs no more
than another.

Cases: kept are vectors with exactly ``size`` components, none null, NaN or infinite, and none of more than ``LARGEST`` as an integer, as
squared distances beyond that do not fit a 64-bit number; others have no row in the result. First centroids are the kept vectors with the
least SHA-256 of ``1:<id>``, equal ids in order of their components; if there are fewer vectors than centroids, all of them. Rows that repeat an id are
clustered each for itself. At equal distances the smaller number wins. A centroid without vectors stays where it is. An empty table
gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from provenant.plans.session import stored

K, ROUNDS, SIZE, SCALE, PIVOTS = 16, 3, 64, 64, 8
#: Largest size of a component: 64 squared differences of twice that stay below 2 ** 63.
LARGEST = 1 << 27
#: Rows whose distances are held at once.
BLOCK = 4096


def integers(vectors: DataFrame, size: int = SIZE, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The kept vectors as integers, with the hash that orders the first centroids."""
    x, limit = F.col(vector_col), float(LARGEST)
    numbers = F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("long"))
    # NaN compares greater than any number; an array of another size or with a null is no match.
    fits = F.forall(x, lambda v: F.coalesce(F.abs(v.cast("double") * F.lit(float(scale))) < limit, F.lit(False)))
    return (vectors.filter((F.size(x) == size) & fits)
            .select(F.col(id_col).alias("vec_id"), numbers.alias("numbers"), F.sha2(F.concat(F.lit("1:"), F.col(id_col).cast("string")), 256).alias("hash")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _lists(matrix: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(matrix.reshape(-1), pa.int64()), matrix.shape[1]).cast(pa.list_(pa.int64()))


def squared(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all points."""
    out = np.empty((len(rows), len(points)), np.int64)
    for j, point in enumerate(points):
        apart = rows - point
        out[:, j] = np.einsum("ij,ij->i", apart, apart)
    return out


def choose_pivots(candidates: np.ndarray, n: int) -> np.ndarray:
    """Pivots far from each other: each next one is that of the largest least distance to those before."""
    chosen = [0]
    least = squared(candidates, candidates[:1])[:, 0]
    while len(chosen) < min(n, len(candidates)):
        chosen.append(int(least.argmax()))
        least = np.minimum(least, squared(candidates, candidates[chosen[-1:]])[:, 0])
    return candidates[chosen]


def nearest(rows: np.ndarray, table: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each row's nearest centroid, and how many distances were worked out.

    ``table`` holds the rows' squared distances to the pivots.
    """
    to_pivots, own = np.sqrt(table.astype(np.float64)), np.sqrt(squared(centroids, pivots).astype(np.float64))
    bounds = np.zeros((len(rows), len(centroids)))
    for j in range(len(pivots)):
        # Roots and their difference are off by a few units in the last place of the larger one.
        larger = np.maximum(to_pivots[:, j, None], own[None, :, j])
        np.maximum(bounds, np.abs(to_pivots[:, j, None] - own[None, :, j]) - larger * 1e-14, out=bounds)
    first = bounds.argmin(axis=1)
    apart = rows - centroids[first]
    best, number = np.einsum("ij,ij->i", apart, apart), first.copy()
    radius = np.sqrt(best.astype(np.float64)) * (1 + 1e-14)
    worked = len(rows)
    for c in range(len(centroids)):
        some = np.flatnonzero((bounds[:, c] <= radius) & (first != c))
        if len(some):
            apart = rows[some] - centroids[c]
            distance = np.einsum("ij,ij->i", apart, apart)
            closer = (distance < best[some]) | ((distance == best[some]) & (c < number[some]))
            best[some[closer]], number[some[closer]] = distance[closer], c
            worked += len(some)
    return number, best, worked


def with_pivots(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Rows with their squared distances to the pivots, as ``table``."""
    width = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables = [squared(_matrix(batch.column("numbers").slice(at, BLOCK), width), pivots) for at in range(0, batch.num_rows, BLOCK)]
            if tables:
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("numbers"), _lists(np.concatenate(tables))], names=["vec_id", "numbers", "table"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "numbers").mapInArrow(run, f"vec_id {kind}, numbers array<bigint>, table array<bigint>")


def _assign(batch: pa.RecordBatch, centroids: np.ndarray, pivots: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, int]]:
    for at in range(0, batch.num_rows, BLOCK):
        some = batch.slice(at, BLOCK)
        rows = _matrix(some.column("numbers"), centroids.shape[1])
        yield some, rows, *nearest(rows, _matrix(some.column("table"), len(pivots)), centroids, pivots)


def sums(rows: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """Vectors, sums of components and distances worked out, per centroid. A sum beyond 64 bits, of over 2 ** 36 vectors, is an error."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, worked = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), width), np.int64), 0
        for batch in batches:
            for _, rows, number, _, some in _assign(batch, centroids, pivots):
                count += np.bincount(number, minlength=len(centroids))
                for c in np.unique(number):
                    total[c] += rows[number == c].sum(axis=0)
                worked += some
        if worked:
            found = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(count[found]), _lists(total[found]),
                                              pa.array([worked] + [0] * (len(found) - 1), pa.int64())], names=["cluster", "n", "sums", "worked"])

    parts = rows.select("numbers", "table").mapInArrow(run, "cluster int, n bigint, sums array<bigint>, worked bigint")
    components = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("worked").alias("worked"), *components)


def by_number(values: list) -> Column:
    """The value of each row's cluster, from a list with one per cluster."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)


class Clustering:
    """The assigned vectors as a written table, the centroids, and per round the distances worked out."""

    def __init__(self, rows: DataFrame, centroids: np.ndarray, worked: list[int]):
        self.rows, self.centroids, self.worked = rows, centroids, worked


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, n_pivots: int = PIVOTS,
            id_col: str = "vec_id", vector_col: str = "embedding") -> Clustering:
    """Each kept vector's cluster and squared distance after ``rounds`` rounds and a last assignment."""
    kept = integers(vectors, size, scale, id_col, vector_col)
    first = kept.orderBy(F.col("hash").asc_nulls_last(), "numbers").limit(k).collect()
    kind = kept.schema["vec_id"].dataType.simpleString()
    if not first:
        return Clustering(kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), np.zeros((0, size), np.int64), [])
    centroids = np.array([r.numbers for r in first], np.int64)
    pivots = choose_pivots(centroids, n_pivots)
    table, worked = stored(with_pivots(kept, pivots)), []
    for _ in range(rounds):
        moved, n = centroids.copy(), 0
        for r in sums(table, centroids, pivots).collect():
            moved[r.cluster] = [r[f"s{i}"] // r.n for i in range(size)]
            n += r.worked
        centroids = moved
        worked.append(n)

    def run(batches: Iterator[pa.RecordBatch], centroids: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, _, number, distance, _ in _assign(batch, centroids, pivots):
                yield pa.RecordBatch.from_arrays([some.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return Clustering(stored(table.mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint")), centroids, worked)


def report(found: Clustering) -> DataFrame:
    """Per vector its cluster and distance, the distances summed over its cluster and over all, and the digest of its centroid."""
    k = len(found.centroids)
    if not k:
        return found.rows.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    totals = {r.cluster: int(r.s) for r in found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    texts = [",".join(map(str, c)) for c in found.centroids.tolist()]
    return found.rows.select("*", by_number([totals.get(c, 0) for c in range(k)]).cast("long").alias("cluster_inertia"),
                             F.lit(sum(totals.values())).cast("long").alias("inertia"), F.sha2(by_number(texts), 256).alias("centroid_sha256"))


def _round_sql(i: int) -> str:
    return f"""
d{i} AS (SELECT v.row_number, c.number, sum((v.x - c.x) * (v.x - c.x)) AS distance FROM parts v JOIN c{i} c ON v.place = c.place GROUP BY ALL),
a{i} AS (SELECT row_number, number, distance FROM d{i} QUALIFY row_number() OVER (PARTITION BY row_number ORDER BY distance, number) = 1),
"""


def _move_sql(i: int) -> str:
    return f"""
m{i} AS (SELECT a.number, p.place, sum(p.x) AS s, count(*) AS n FROM a{i} a JOIN parts p USING (row_number) GROUP BY ALL),
c{i + 1} AS (SELECT c.number, c.place, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.x) AS x
             FROM c{i} c LEFT JOIN m{i} m ON c.number = m.number AND c.place = m.place),
"""


CLUSTER_SQL = """
WITH kept AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS numbers, sha256('1:' || vec_id) AS hash,
         row_number() OVER (ORDER BY vec_id) AS row_number
  FROM embeddings WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64),
parts AS (SELECT row_number, unnest(numbers) AS x, generate_subscripts(numbers, 1) AS place FROM kept),
first AS (SELECT row_number, row_number() OVER (ORDER BY hash) - 1 AS number FROM kept QUALIFY number < 16),
c0 AS (SELECT f.number, p.place, p.x FROM first f JOIN parts p USING (row_number)),
""" + "".join(_round_sql(i) + _move_sql(i) for i in range(ROUNDS)) + _round_sql(ROUNDS) + f"""
digests AS (SELECT number, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY place)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY ALL)
SELECT k.vec_id, CAST(a.number AS INTEGER) AS "cluster", CAST(a.distance AS BIGINT) AS distance,
       CAST(sum(a.distance) OVER (PARTITION BY a.number) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, d.centroid_sha256
FROM a{ROUNDS} a JOIN kept k USING (row_number) JOIN digests d ON d.number = a.number
"""
