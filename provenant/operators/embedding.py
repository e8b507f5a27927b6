"""Embedding through a batch plug-in, and centroids."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Literal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from provenant.functions.text import tokenize
from provenant.settings import Settings

Role = Literal["document", "query"]
EmbedBatch = Callable[[list[str], Role], Sequence[Sequence[float]]]


def embed(rows: DataFrame, text: str, role: Role, plugin: EmbedBatch, settings: Settings = Settings(),
          output: str = "embedding") -> DataFrame:
    """Call ``plugin(texts, role)`` on batches of at most ``embed_batch_size`` texts.

    Rows keep their columns and order. The role has no default: documents and questions are
    embedded differently. A blank text or a short answer from the plug-in is an error.
    """
    if role not in ("document", "query"):
        raise ValueError(f"role must be document or query, not {role!r}")
    size = settings.embed_batch_size

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame[text].tolist()
            if any(t is None or not t.strip() for t in texts):
                raise ValueError("cannot embed an empty text")
            vectors: list = []
            for start in range(0, len(texts), size):
                batch = texts[start:start + size]
                answer = plugin(batch, role)
                if len(answer) != len(batch):
                    raise ValueError(f"plug-in gave {len(answer)} vectors for {len(batch)} texts")
                vectors.extend(np.asarray(v, dtype=np.float32) for v in answer)
            yield frame.assign(**{output: vectors})

    schema = T.StructType(rows.schema.fields + [T.StructField(output, T.ArrayType(T.FloatType()))])
    return rows.mapInPandas(run, schema)


def hashed_embedding(rows: DataFrame, text: str, dims: int = 256, output: str = "embedding") -> DataFrame:
    """Offline embedding without a model: token counts in hashed buckets, scaled to unit length."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    counted = HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=dims).transform(
        rows.withColumn("_tokens", tokenize(F.col(text))))
    unit = Normalizer(inputCol="_counts", outputCol="_unit").transform(counted)
    return unit.withColumn(output, vector_to_array("_unit", "float32")).drop("_tokens", "_counts", "_unit")


def centroids(chunks: DataFrame, by: Sequence[str], vector: str = "embedding") -> DataFrame:
    """Mean vector per group: one partial average per dimension, so groups may be of any size."""
    cells = chunks.filter(F.col(vector).isNotNull()).select(*by, F.posexplode(vector).alias("dim", "x"))
    means = cells.groupBy(*by, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    ordered = F.array_sort(F.collect_list(F.struct("dim", "mean")))
    return means.groupBy(*by).agg(F.transform(ordered, lambda c: c["mean"]).alias("centroid"))
