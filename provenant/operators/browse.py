"""Acts, provisions and ingestion coverage for readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from provenant.functions import patterns as P
from provenant.operators.hierarchy import nest
from provenant.sources.tables import lookup


def list_acts(acts: DataFrame, by_number: bool = False) -> DataFrame:
    """By year, then English name or act number; names order by their UTF-8 bytes."""
    return acts.orderBy("act_year", "act_number" if by_number else "full_name_en")


def search_acts(acts: DataFrame, term: str) -> DataFrame:
    needle = F.lower(F.lit(term))
    return acts.filter(F.lower("short_name").contains(needle) | F.lower("full_name_en").contains(needle))


def act_structure(acts: DataFrame, provisions: DataFrame, slug: str) -> DataFrame:
    """The act with its provision tree, one row per top-level provision in order."""
    act = lookup(acts, slug=slug).select(F.col("id").alias("act_id"), "slug", "full_name_en")
    own = provisions.join(act.select("act_id"), "act_id", "left_semi")
    return act.join(nest(own), "act_id").orderBy("sort_path")


def _detail(provisions: DataFrame, acts: DataFrame, revisions: DataFrame, disclaimer: str) -> DataFrame:
    heading = F.concat("full_name_en", F.lit(" > "), F.initcap("kind"), F.lit(" "), "number")
    path = F.when(F.coalesce("title", F.lit("")) != "", F.concat(heading, F.lit(" ("), "title", F.lit(")"))).otherwise(heading)
    fields = F.struct("language", "effective_from", "effective_to", "translation_status", "text", "source_url")
    dated = revisions.join(provisions.select(F.col("id").alias("provision_id")), "provision_id", "left_semi").groupBy(
        "provision_id").agg(F.array_sort(F.collect_list(fields)).alias("revisions"))
    named = acts.select(F.col("id").alias("act_id"), "slug", "full_name_en")
    rows = provisions.join(named, "act_id").withColumnRenamed("id", "provision_id").join(dated, "provision_id", "left")
    return rows.select("provision_id", F.col("slug").alias("act_slug"), "kind", "number", "title",
                       path.alias("hierarchy_path"), F.coalesce("revisions", F.array()).alias("revisions"),
                       F.lit(disclaimer).alias("disclaimer"))


def section_detail(acts: DataFrame, provisions: DataFrame, revisions: DataFrame, slug: str, number: str,
                   disclaimer: str) -> DataFrame:
    """The provision of that number in the act, the first by path, with all its revisions."""
    act = lookup(acts, slug=slug)
    named = lookup(provisions, number=number).join(act.select(F.col("id").alias("act_id")), "act_id", "left_semi")
    return _detail(named.orderBy("sort_path", "id").limit(1), act, revisions, disclaimer)


def provision_detail(acts: DataFrame, provisions: DataFrame, revisions: DataFrame, provision_id: str,
                     disclaimer: str) -> DataFrame:
    return _detail(lookup(provisions, id=provision_id), acts, revisions, disclaimer)


def section_lines(provisions: DataFrame, tree: str = "act_id") -> DataFrame:
    """One markdown line per provision; sections inside a chapter are indented, a part resets it."""
    so_far = Window.partitionBy(tree).orderBy("sort_path").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.last(F.when(F.col("kind").isin("part", "chapter"), F.col("kind")), True).over(so_far) == "chapter"
    has_title = F.coalesce("title", F.lit("")) != ""
    titled = lambda mark: F.when(has_title, F.concat(F.lit(mark), "title")).otherwise("")
    line = (F.when(F.col("kind") == "part", F.concat(F.lit(P.PART_LINE), "number", titled(P.TITLE_MARK)))
            .when(F.col("kind") == "chapter", F.concat(F.lit(P.CHAPTER_LINE), "number", titled(P.TITLE_MARK)))
            .when(F.col("kind") == "section", F.concat(
                F.when(inside, P.SECTION_IN_CHAPTER).otherwise(P.SECTION_ALONE), F.lit(P.SECTION_SIGN), "number", titled(P.SECTION_TITLE_MARK)))
            .otherwise(F.concat(F.lit(P.OTHER_LINE[0]), "number", F.lit(P.OTHER_LINE[1]))))
    return provisions.filter("kind <> 'act'").withColumn("line", line)


def section_list(acts: DataFrame, provisions: DataFrame, language: str = "en") -> DataFrame:
    """(act_id, text): an act's sections as one markdown document."""
    rows = section_lines(provisions)
    body = rows.groupBy("act_id").agg(
        F.array_sort(F.collect_list(F.struct("sort_path", "id", "line"))).alias("l"))
    counts = provisions.groupBy("act_id").agg(F.count(F.lit(1)).alias("n"))
    name = F.col("full_name_bn" if language == "bn" else "full_name_en")
    head = F.array(F.concat(F.lit(P.ACT_HEAD), name),
                   F.concat(F.lit(P.ACT_NUMBER), "act_number", F.lit(P.ACT_OF), F.col("act_year").cast("string"), F.lit(P.ACT_END)), F.lit(""))
    joined = acts.withColumnRenamed("id", "act_id").join(body, "act_id", "left").join(counts, "act_id", "left")
    lines = F.coalesce(F.transform("l", lambda x: x["line"]), F.array().cast("array<string>"))
    tail = F.when(F.coalesce("n", F.lit(0)) <= 1, F.array(F.lit(P.NOT_INDEXED))).otherwise(F.array().cast("array<string>"))
    return joined.select("act_id", F.array_join(F.concat(head, lines, tail), "\n").alias("text"))


def latest_runs(acts: DataFrame, runs: DataFrame, languages: tuple[str, ...] = ("bn", "en")) -> DataFrame:
    """Acts with last_run_{language} structs; acts without runs are kept with nulls.

    The newest run per act and language is one aggregate with a map-side part.
    """
    fields = ["id", "status", "started_at", "finished_at", "provisions_processed", "chunks_created", "error"]
    def newest(language: str) -> Column:
        mine = F.col("language") == language
        return F.max_by(F.when(mine, F.struct(*fields)), F.when(mine, F.struct("started_at", "id"))).alias(f"last_run_{language}")
    last = runs.groupBy("act_id").agg(*[newest(x) for x in languages])
    return acts.withColumnRenamed("id", "act_id").join(last, "act_id", "left")


def coverage(latest: DataFrame) -> DataFrame:
    """Total chunks, acts ingested in any language, acts ingested in both, over the latest runs."""
    chunks = lambda x: F.coalesce(F.col(f"last_run_{x}.chunks_created"), F.lit(0))
    done = lambda x: F.coalesce(F.col(f"last_run_{x}.status") == "succeeded", F.lit(False))
    return latest.agg(F.coalesce(F.sum(chunks("bn") + chunks("en")), F.lit(0)).alias("total_chunks"),
                      F.count_if(done("bn") | done("en")).alias("ingested_acts"),
                      F.count_if(done("bn") & done("en")).alias("fully_ingested_acts"))


def snapshot_date() -> Column:
    """Day of the Bengali run, or of the English one; null unless that run succeeded."""
    run = F.coalesce("last_run_bn", "last_run_en")
    return F.when(run["status"] == "succeeded", F.to_date(run["started_at"]))
