"""Content hashes, stable ids, cache keys and pseudonyms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from provenant.functions.text import norm_title


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def stable_id(*parts: Column) -> Column:
    """An id that a retried task computes again unchanged."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)


def cache_key(query: Column, chunk_ids: Column, as_of: Column, model: Column | str,
              prompt_version: Column | str, reranker_version: Column | str) -> Column:
    """Same question over the same chunks, in whatever order, gives the same key."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    payload = F.concat_ws(
        "|", norm_title(F.lower(query)), F.array_join(F.array_sort(chunk_ids), "|"),
        F.date_format(as_of, "yyyy-MM-dd"), lit(model), lit(prompt_version), lit(reranker_version))
    return F.concat(F.lit("response:"), F.sha2(payload, 256))


def ip_hash(ip: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(ip, F.lit("unknown")), 256), 1, 16)
