"""Revisions to overlapping chunks under a token budget, in one projection per step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from provenant.functions.hashing import stable_id
from provenant.functions.regex import strip
from provenant.functions.text import token_count, tokenize
from provenant.settings import Settings


def paragraphs(text: Column, budget: Column) -> Column:
    """Blank-line paragraphs; one over the budget gives its lines if all of those fit."""
    def expand(paragraph: Column) -> Column:
        lines = F.filter(F.transform(F.split(paragraph, "\n", -1), strip), lambda x: x != "")
        fits = F.forall(lines, lambda x: token_count(x) <= budget)
        return F.when((token_count(paragraph) > budget) & fits, lines).otherwise(F.array(strip(paragraph)))
    blocks = F.filter(F.split(strip(text), r"\n{2,}", -1), lambda p: strip(p) != "")
    return F.flatten(F.transform(blocks, expand))


def segment_starts(sizes: Column, budget: Column) -> Column:
    """First paragraph (from 0) of every segment, packed greedily in order.

    The fold carries the size of the open segment and the starts so far; a segment is closed
    when the next paragraph would pass the budget.
    """
    state = F.struct(F.lit(0).alias("used"), F.lit(0).alias("at"), F.array(F.lit(0)).alias("starts"))

    def step(acc: Column, size: Column) -> Column:
        full = (acc["used"] > 0) & (acc["used"] + size > budget)
        return F.struct(
            F.when(full, size).otherwise(acc["used"] + size).alias("used"),
            (acc["at"] + 1).alias("at"),
            F.when(full, F.concat(acc["starts"], F.array(acc["at"]))).otherwise(acc["starts"]).alias("starts"))
    return F.aggregate(sizes, state, step, lambda acc: acc["starts"])


def pack_paragraphs(rows: DataFrame, text: str, budget: Column, bodies: str = "bodies") -> DataFrame:
    """Add the array of segment bodies of ``text``."""
    split = rows.withColumn("_budget", budget).withColumn("_paras", paragraphs(F.col(text), F.col("_budget")))
    split = split.withColumn("_starts", segment_starts(
        F.transform("_paras", lambda p: token_count(p)), F.col("_budget")))
    ends = F.concat(F.slice("_starts", F.lit(2), F.size("_starts")), F.array(F.size("_paras")))
    bounds = split.withColumn("_ends", ends)
    packed = F.zip_with("_starts", "_ends", lambda a, b: F.array_join(
        F.slice(F.col("_paras"), a + 1, b - a), "\n\n"))
    return bounds.withColumn(bodies, packed).drop("_budget", "_paras", "_starts", "_ends")


def with_overlap(bodies: Column, overlap_tokens: int) -> Column:
    """Every segment but the first opens with the tail of the previous body."""
    if overlap_tokens == 0:
        return bodies
    tails = F.transform(bodies, lambda b: F.right(b, F.lit(overlap_tokens * 4)))
    previous = F.concat(F.array(F.lit("")), F.slice(tails, 1, F.greatest(F.size(bodies) - 1, F.lit(0))))
    return F.zip_with(bodies, previous, lambda body, tail: F.when(tail == "", body).otherwise(
        strip(F.concat(tail, F.lit("\n"), body))))


def chunk(revisions: DataFrame, settings: Settings, path: str = "hierarchy_path", text: str = "text") -> DataFrame:
    """Explode revisions into chunks; all other columns are carried along.

    Adds chunk_index, content and token_count. Every chunk starts with the hierarchy path; the
    overlap is not counted against the budget.
    """
    whole = revisions.withColumn("_text", strip(F.col(text))).filter("_text <> ''")
    whole = whole.withColumn("_one", F.concat(F.col(path), F.lit("\n"), F.col("_text")))
    fits = token_count(F.col("_one")) <= settings.chunk_max_tokens
    budget = F.greatest(F.lit(1), F.lit(settings.chunk_max_tokens) - token_count(F.col(path)) - 1)
    # Only texts over the limit are packed; the others are their own single segment.
    packed = pack_paragraphs(
        whole.withColumn("_fits", fits).withColumn("_long", F.when(~F.col("_fits"), F.col("_text"))),
        "_long", budget, "_bodies")
    segments = F.when(F.col("_fits"), F.array("_text")).otherwise(
        with_overlap(F.col("_bodies"), settings.chunk_overlap_tokens))
    # Segments are never empty; the outer form keeps the optimizer from checking that by
    # computing them a second time in a filter below.
    rows = packed.withColumn("_segments", segments).select(
        *[F.col(c) for c in revisions.columns], F.posexplode_outer("_segments").alias("chunk_index", "_segment"))
    content = F.concat(F.col(path), F.lit("\n"), F.col("_segment"))
    return rows.withColumn("content", content).withColumn(
        "token_count", token_count(F.col("content"))).drop("_segment")


def corpus_chunks(revisions: DataFrame, settings: Settings) -> DataFrame:
    """Chunk rows of the corpus, with ids that a rerun computes again and stored tokens."""
    rows = chunk(revisions.withColumnRenamed("id", "revision_id"), settings)
    return rows.select(
        stable_id(F.col("revision_id"), F.col("chunk_index")).alias("id"), "revision_id", "provision_id",
        "act_id", "chunk_index", "language", "hierarchy_path", "content",
        tokenize(F.col("content")).alias("tokens"), "token_count")
