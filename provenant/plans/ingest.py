"""From page snapshots to provisions, dated revisions and chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from provenant import schemas
from provenant.functions.hashing import stable_id
from provenant.operators import bucketed, chunking, hierarchy, parsing, revisions as rev
from provenant.plans.session import stored
from provenant.settings import Settings


#: Stored chunks, as ``chunking.corpus_chunks`` gives them.
CHUNKS = T.StructType([schemas.CHUNKS[c] for c in (
    "id", "revision_id", "provision_id", "act_id", "chunk_index", "language", "hierarchy_path", "content", "tokens", "token_count")])


@dataclass(frozen=True)
class Ingested:
    provisions: DataFrame
    revisions: DataFrame
    chunks: DataFrame
    outcomes: DataFrame
    runs: DataFrame
    summary: DataFrame
    warnings: DataFrame


def identified(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Parsed nodes as one tree per page, with ids from page and ordinal and the page's fields."""
    node_id = lambda c: F.when(F.col(c).isNotNull(), stable_id(F.col("page_id"), F.col(c)))
    about = pages.select("page_id", F.col("slug").alias("act_id"), "language", "fetched_at", "root_label")
    return nodes.join(about, "page_id").withColumns({"id": node_id("ordinal"), "parent_id": node_id("parent_ordinal")})


def _labels(acts: DataFrame) -> DataFrame:
    return acts.select("slug", F.concat("full_name_en", F.lit(", "), F.col("act_year").cast("string")).alias("root_label"))


def _named(tree: DataFrame, position: Column) -> DataFrame:
    """Placed nodes as provisions; of those with one path the last by ``position`` counts."""
    return tree.select(
        F.col("provision_id").alias("id"), "act_id", F.when(F.col("parent_id").isNotNull(), stable_id(
            F.col("act_id"), F.regexp_replace("sort_path", "/[^/]*$", ""))).alias("parent_id"),
        "kind", "number", "title", "sort_path", position.alias("ordinal"))


def _steps(of_act: DataFrame, fresh: DataFrame, warnings: DataFrame, changed: DataFrame, idle: DataFrame) -> DataFrame:
    """What happened to each act and language, as ``revisions.run_log`` reads it."""
    none = lambda kind: F.lit(None).cast(kind)
    return (of_act.select("act_id", "language", "outcome", none("string").alias("error"), F.lit(0).alias("chunks"))
            .unionByName(fresh.groupBy("act_id", "language").agg(F.count(F.lit(1)).cast("int").alias("chunks")).select(
                "act_id", "language", none("string").alias("outcome"), none("string").alias("error"), "chunks"))
            .unionByName(warnings.filter(F.col("message").startswith("unexpected error")).select(
                "act_id", "language", none("string").alias("outcome"), F.col("message").alias("error"), F.lit(0).alias("chunks")))
            .unionByName(changed.select(F.col("slug").alias("act_id"), "language", none("string").alias("outcome"),
                                        none("string").alias("error"), F.lit(0).alias("chunks")))
            .unionByName(idle.withColumn("outcome", none("string"))))


def ingest(pages: DataFrame, acts: DataFrame, provisions: DataFrame, revisions: DataFrame, chunks: DataFrame,
           started_at: Column, finished_at: Column, base: str = "", settings: Settings = Settings()) -> Ingested:
    """One set-based pass over all pages; acts are named by slug.

    pages: page_id, slug, language, url, html, fetched_at, not_modified. A page that cannot be
    parsed yields a warning and fails its own run only.
    """
    changed, idle = rev.split_not_modified(pages.join(_labels(acts), "slug"))
    nodes, warnings = parsing.parse_pages(changed, base)
    tree = hierarchy.descend(stored(identified(nodes, changed)), "page_id", "root_label")
    # A path names a provision of an act in every language. Parsed once, read by every step below.
    tree = stored(tree.withColumn("provision_id", stable_id(F.col("act_id"), F.col("sort_path"))))
    merged_provisions = rev.upsert_provisions(provisions, _named(tree, F.struct("language", "ordinal"))).drop("outcome")

    dated = tree.withColumn("provenance", F.lit("snapshot"))
    merged, outcomes = (stored(part) for part in rev.merge_revisions(revisions, dated))
    labelled = tree.groupBy("provision_id", "language").agg(
        F.max_by(F.struct("act_id", "hierarchy_path"), "ordinal").alias("p")).select(
        "provision_id", "language", "p.act_id", "p.hierarchy_path")
    pending = rev.pending_revisions(merged, outcomes).join(labelled, ["provision_id", "language"])
    fresh = stored(chunking.corpus_chunks(pending, settings))
    kept = rev.replace_chunks(chunks.select(*fresh.columns), fresh)

    of_act = outcomes.join(labelled.drop("hierarchy_path"), ["provision_id", "language"])
    errors = warnings.join(changed.select("page_id", F.col("slug").alias("act_id"), "language"), "page_id")
    steps = _steps(of_act, fresh, errors, changed, idle)
    return Ingested(merged_provisions, merged, kept, outcomes, rev.run_log(steps, started_at, finished_at),
                    rev.ingest_summary(of_act, ["act_id", "language"], fresh), warnings)


def begin_corpus(spark: SparkSession, root: str) -> None:
    """Empty provisions, revisions and chunks for ``ingest_batch`` to append to."""
    bucketed.begin_provisions(spark, root)
    bucketed.begin_revisions(spark, root)
    bucketed.begin_chunks(spark, root, CHUNKS)


def ingest_batch(pages: DataFrame, acts: DataFrame, root: str, batch: int, started_at: Column, finished_at: Column,
                 base: str = "", settings: Settings = Settings()) -> None:
    """``ingest`` of one batch into the corpus stored at ``root``, which only grows by what the batch changes.

    A page may be in the batch more than once: its fetches are parsed one by one and merged in time order. Runs and warnings are
    tables by batch. Texts are shuffled to their paths, to their buckets and to their chunks.
    """
    spark, labels = pages.sparkSession, _labels(acts)
    changed, idle = rev.split_not_modified(pages)
    # The fields of a fetch travel with its nodes, so no page has to be met again.
    fetch = F.struct(F.monotonically_increasing_id().alias("fetch"), F.col("slug").alias("act_id"), "language", "fetched_at")
    found, told = parsing.parse_pages(changed.select(fetch.alias("page_id"), "url", "html"), base)
    node_id = lambda c: F.when(F.col(c).isNotNull(), stable_id(F.col("fetch"), F.col(c)))
    nodes = stored(found.select("page_id.*", *[c for c in found.columns if c != "page_id"]).withColumns(
        {"id": node_id("ordinal"), "parent_id": node_id("parent_ordinal")}))
    bare = nodes.drop("text", "source_url").join(labels.withColumnRenamed("slug", "act_id"), "act_id")
    placed = hierarchy.descend(stored(bare), "fetch", "root_label").select("fetch", "id", "sort_path", "hierarchy_path")
    tree = stored(nodes.join(placed, ["fetch", "id"]).withColumn("provision_id", stable_id(F.col("act_id"), F.col("sort_path"))))

    bucketed.merge_provisions(spark, root, _named(tree, F.struct("fetched_at", "language", "ordinal")), batch)
    outcomes = stored(bucketed.merge_revisions(spark, root, tree.select(
        "provision_id", "language", "text", "source_url", "fetched_at", "ordinal", F.lit("snapshot").alias("provenance")), batch))
    labelled = stored(tree.groupBy("provision_id", "language").agg(F.max_by(
        F.struct("act_id", "hierarchy_path"), F.struct("fetched_at", "ordinal")).alias("p")).select("provision_id", "language", "p.act_id", "p.hierarchy_path"))

    def with_act(rows: DataFrame, *more: str) -> DataFrame:
        same = (rows["provision_id"] == labelled["provision_id"]) & rows["language"].eqNullSafe(labelled["language"])
        return rows.join(labelled, same).select(*[rows[c] for c in rows.columns], "act_id", *more)

    pending = with_act(bucketed.opened_revisions(spark, root, batch), "hierarchy_path")
    bucketed.replace_chunks(chunking.corpus_chunks(pending, settings), root, batch)
    fresh = bucketed.written_chunks(spark, root, CHUNKS, batch)

    warnings = stored(told.select("page_id.*", "message", "context").drop("fetch"))
    known = lambda rows, name: rows.join(acts.select(F.col("slug").alias(name)).distinct(), name, "left_semi")
    steps = _steps(with_act(outcomes), fresh, known(warnings, "act_id"), known(changed.select("slug", "language"), "slug"), known(idle, "act_id"))
    rev.run_log(steps, started_at, finished_at).write.mode("overwrite").parquet(f"{root}/runs/batch={batch}")
    known(warnings, "act_id").write.mode("overwrite").parquet(f"{root}/warnings/batch={batch}")
