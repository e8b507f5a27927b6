"""Predicates, fusion, fallback, reranking and tiers over (query, chunk) hits.

Hits carry ids and scores only; payload columns are joined after the last cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from provenant.functions.text import tokenize
from provenant.operators.lexical import lexical_topn
from provenant.operators.postings import Index, write_index
from provenant.operators.vectors import vector_topn
from provenant.plans.session import stored
from provenant.plans.skew import top_per_group
from provenant.settings import Settings

ScorePairs = Callable[[list[str], list[str]], Sequence[float]]


def as_of(revisions: DataFrame, day: Column, latest_only: Sequence[str] | None = None) -> DataFrame:
    """Rows in force on a day; both bounds count, so a closing day belongs to both rows.

    ``latest_only`` names key columns and keeps the later of such a pair.
    """
    in_force = revisions.filter((F.col("effective_from") <= day) & (
        F.col("effective_to").isNull() | (F.col("effective_to") >= day)))
    if latest_only is None:
        return in_force
    return top_per_group(in_force, latest_only, [F.desc("effective_from"), F.desc("id")], 1, "_n").drop("_n")


def scope(chunks: DataFrame, language: str | None = None, acts: Sequence[str] = ()) -> DataFrame:
    """Chunks of a language and of the given acts; no acts means all."""
    conditions = [F.lit(True)]
    if language is not None:
        conditions.append(F.col("language") == language)
    if acts:
        conditions.append(F.col("act_id").isin(*acts))
    return chunks.filter(reduce(lambda a, b: a & b, conditions))


def with_revision(chunks: DataFrame, revisions: DataFrame) -> DataFrame:
    """Add each chunk's dates and source address."""
    dates = revisions.select(F.col("id").alias("revision_id"), "effective_from", "effective_to", "source_url")
    return chunks.join(dates, "revision_id")


def rrf(vector_hits: DataFrame | None, lexical_hits: DataFrame | None, settings: Settings = Settings()) -> DataFrame:
    """(query_id, chunk_id, score) by reciprocal ranks.

    A chunk found only by vector needs the similarity threshold; a lexical hit always passes.
    """
    def side(hits: DataFrame, weight: float, lexical: bool) -> DataFrame:
        return hits.select(
            "query_id", "chunk_id", (F.lit(weight) / (settings.rrf_k + F.col("rank"))).alias("part"),
            F.lit(lexical).alias("lexical"), (F.lit(None).cast("double") if lexical else F.col("score")).alias("similarity"))
    sides = []
    if vector_hits is not None and settings.vector_weight > 0:
        sides.append(side(vector_hits, settings.vector_weight, False))
    if lexical_hits is not None and settings.lexical_weight > 0:
        sides.append(side(lexical_hits, settings.lexical_weight, True))
    if not sides:
        raise ValueError("no signal to fuse")
    fused = reduce(DataFrame.unionByName, sides).groupBy("query_id", "chunk_id").agg(
        F.sum("part").alias("score"), F.bool_or("lexical").alias("lexical"), F.max("similarity").alias("similarity"))
    return fused.filter(F.col("lexical") | (F.coalesce("similarity", F.lit(0.0)) >= settings.similarity_threshold)
                        ).select("query_id", "chunk_id", "score")


def hybrid(queries: DataFrame, chunks: DataFrame, settings: Settings = Settings(), index: Index | None = None) -> DataFrame:
    """(query_id, chunk_id, score): both signals fused; one of weight 0 is not computed.

    A query without a vector is answered by text alone. ``index`` is that of the chunks' tokens.
    """
    vectors = lexical = None
    if settings.vector_weight > 0 and "embedding" in queries.columns and "embedding" in chunks.columns:
        vectors = vector_topn(queries, chunks, settings.top_n, settings)
    if settings.lexical_weight > 0:
        lexical = lexical_topn(queries, chunks, settings.top_n, settings, index)
    return rrf(vectors, lexical, settings)


def needs_fallback(queries: DataFrame, hits: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Queries whose best fused score is under the floor, or that found nothing."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("_best"))
    return queries.join(best, "query_id", "left").filter(
        F.coalesce("_best", F.lit(0.0)) < settings.cross_lingual_floor).drop("_best")


def with_fallback(queries: DataFrame, chunks: DataFrame, settings: Settings = Settings(),
                  other: Callable[[Column], Column] = lambda c: F.when(c == "bn", "en").otherwise("bn"),
                  search: Callable[[DataFrame, DataFrame, Settings], DataFrame] | None = None,
                  index: Index | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, flags): weak queries also search the other language with the same vector.

    Hits keep ``source`` (0 own language, 1 other) to order equal scores. The flag is set
    whether or not the second search finds anything.

    The first search is stored: its hits are merged, and they decide who searches again. Both go by one index of the chunks.
    """
    if search is None:
        search = partial(hybrid, index=index or (write_index(chunks) if settings.lexical_weight > 0 else None))
    own = stored(search(queries, chunks, settings))
    weak = needs_fallback(queries, own, settings)
    second = search(weak.withColumn("language", other(F.col("language"))), chunks, settings)
    hits = own.withColumn("source", F.lit(0)).unionByName(second.withColumn("source", F.lit(1)))
    flagged = weak.select("query_id").distinct().withColumn("cross_lingual", F.lit(True))
    flags = queries.select("query_id").join(flagged, "query_id", "left").withColumn(
        "cross_lingual", F.coalesce("cross_lingual", F.lit(False)))
    return hits, flags


def overlap_score(question: Column, content: Column) -> Column:
    """Share of a question's distinct words that the content has."""
    words = F.array_distinct(tokenize(question))
    return F.size(F.array_intersect(words, tokenize(content))) / F.nullif(F.size(words), F.lit(0))


def rerank(hits: DataFrame, queries: DataFrame, contents: DataFrame, scorer: ScorePairs | None = None,
           settings: Settings = Settings(), scores: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rerank_score, reranked, rank): fused candidates scored anew.

    The cut to ``rerank_top_n`` comes before texts are joined. Scores come from ``scores``
    (query_id, chunk_id, rerank_score), from ``scorer`` over batches of pairs, or from word
    overlap. A query with an unscored pair keeps its fused order and reranked = false.
    """
    order = [F.desc("score"), *([F.asc("source")] if "source" in hits.columns else []), F.asc("chunk_id")]
    cut = top_per_group(hits, ["query_id"], order, settings.rerank_top_n, "fused_rank").select(
        "query_id", "chunk_id", "score", "fused_rank")
    if scores is not None:
        scored = cut.join(scores, ["query_id", "chunk_id"], "left")
    else:
        # Stored, the cut has a known size: Spark can broadcast its ids, so that only texts of candidates are shuffled.
        cut = stored(cut)
        texts = contents.select("chunk_id", "content").join(cut.select("chunk_id").distinct(), "chunk_id", "left_semi")
        pairs = cut.join(queries.select("query_id", "query_text"), "query_id").join(texts, "chunk_id")
        if scorer is None:
            scored = pairs.withColumn("rerank_score", overlap_score(F.col("query_text"), F.col("content")))
        else:
            scored = _score_batches(pairs, scorer)
        scored = scored.drop("query_text", "content")
    whole = Window.partitionBy("query_id")
    scored = scored.withColumn("reranked", F.count("rerank_score").over(whole) == F.count(F.lit(1)).over(whole))
    best = Window.partitionBy("query_id").orderBy(
        F.when(F.col("reranked"), F.col("rerank_score")).desc_nulls_last(), F.asc("fused_rank"))
    return scored.withColumn("rank", F.row_number().over(best)).drop("fused_rank")


class ScorerUnavailable(Exception):
    """Raised by a scorer that cannot be reached; other errors of a scorer fail the job."""


def _score_batches(pairs: DataFrame, scorer: ScorePairs) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            try:
                values = list(scorer(frame["query_text"].tolist(), frame["content"].tolist()))
            except ScorerUnavailable:  # leaves the fused order
                values = [None] * len(frame)
            yield frame.assign(rerank_score=pd.Series(values, index=frame.index, dtype="float64"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.mapInPandas(run, f"{fields}, rerank_score double")


def topk(hits: DataFrame, k: int) -> DataFrame:
    """The first k ranked hits per query."""
    return hits.filter(F.col("rank") <= k)


def confidence(queries: DataFrame, hits: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(query_id, confidence): queries without hits, reranking or own-language hits are LOW.

    ``queries`` has query_id and cross_lingual; ``hits`` the reranked ones.
    """
    top = hits.filter("rank = 1").select("query_id", "reranked", "rerank_score")
    joined = queries.join(top, "query_id", "left")
    usable = F.coalesce("reranked", F.lit(False)) & ~F.coalesce("cross_lingual", F.lit(False))
    score = F.coalesce("rerank_score", F.lit(0.0))
    tier = (F.when(~usable, "LOW").when(score >= settings.confidence_high, "HIGH")
            .when(score >= settings.confidence_medium, "MEDIUM").otherwise("LOW"))
    return joined.select("query_id", tier.alias("confidence"))
