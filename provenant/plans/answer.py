"""A table of questions against a table of chunks, end to end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from provenant.functions.language import detect_language, search_language
from provenant.operators import retrieval
from provenant.operators.retrieval import ScorePairs
from provenant.plans.session import stored
from provenant.settings import Settings


@dataclass(frozen=True)
class Retrieved:
    queries: DataFrame
    hits: DataFrame
    confidence: DataFrame


def routed(queries: DataFrame, today: Column) -> DataFrame:
    """Add detected_language, language (searched) and as_of; a requested language wins."""
    detected = detect_language(F.col("query_text"))["language"]
    if "requested_language" in queries.columns:
        detected = F.coalesce("requested_language", detected)
    day = F.coalesce("as_of", today) if "as_of" in queries.columns else today
    return queries.withColumn("detected_language", detected).withColumns(
        {"language": search_language(F.col("detected_language")), "as_of": day})


def retrieve(queries: DataFrame, chunks: DataFrame, revisions: DataFrame, today: Column,
             scorer: ScorePairs | None = None, settings: Settings = Settings()) -> Retrieved:
    """Top chunks per question with texts and addresses, and the confidence tier.

    queries: query_id, query_text and optionally embedding, act_ids, as_of, requested_language.
    Texts join after the cut to ``top_k``.
    """
    asked = routed(queries, today)
    dated = retrieval.with_revision(chunks.withColumnRenamed("id", "chunk_id"), revisions)
    fused, flags = retrieval.with_fallback(asked, dated, settings)
    ranked = stored(retrieval.topk(retrieval.rerank(fused, asked, dated, scorer, settings), settings.top_k))
    payload = dated.select("chunk_id", "act_id", "hierarchy_path", "content", "source_url", F.col("language").alias("chunk_language"))
    return Retrieved(asked.join(flags, "query_id"), ranked.join(payload, "chunk_id"),
                     retrieval.confidence(flags, ranked, settings))
