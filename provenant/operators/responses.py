"""Answers: citations, context blocks, disclaimers and the path each response takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from provenant.functions import patterns as P, policy
from provenant.functions.hashing import cache_key
from provenant.functions.language import response_language
from provenant.functions.text import token_count, token_count_of_length
from provenant.settings import Settings


def citation_contexts(hits: DataFrame, acts: DataFrame) -> DataFrame:
    """Hits of known acts with the fields of a citation; hits of unknown acts give none."""
    named = acts.select(F.col("id").alias("act_id"), F.struct(
        "full_name_en", "full_name_bn", "act_year").alias("act"))
    return hits.join(named, "act_id").select(
        "query_id", "chunk_id", "rank", F.col("act.full_name_en").alias("act_name_en"),
        F.col("act.full_name_bn").alias("act_name_bn"), F.col("act.act_year").alias("act_year"),
        policy.section_reference(F.col("hierarchy_path")).alias("section_ref"), "source_url")


#: Between the blocks of a context.
_BETWEEN = "\n\n"
_CONTEXT = ["act_name_en", "act_name_bn", "act_year", "section_ref", "source_url"]


def citation_maps(contexts: DataFrame, languages: DataFrame) -> DataFrame:
    """(query_id, citations, cited): citation by chunk id, and the ids in rank order.

    A query has at most top_k hits, so its map is small.
    """
    cited = contexts.join(languages.select("query_id", "language"), "query_id").select(
        "query_id", F.struct(
            F.col("rank"), F.col("chunk_id").cast("string").alias("id"),
            policy.format_citation(F.struct(*_CONTEXT), F.col("language")).alias("text")).alias("c"))
    rows = cited.groupBy("query_id").agg(F.array_sort(F.collect_list("c")).alias("c"))
    return rows.select(
        "query_id", F.map_from_arrays(F.transform("c", lambda c: c["id"]), F.transform("c", lambda c: c["text"])).alias("citations"),
        F.transform("c", lambda c: c["id"]).alias("cited"))


def resolve_responses(responses: DataFrame, contexts: DataFrame, text: str = "text") -> DataFrame:
    """Replace the placeholders of each response by the citations of its own query.

    responses: query_id, language, text. One join; the text is rebuilt inside the row.
    """
    maps = citation_maps(contexts, responses.select("query_id", "language").distinct())
    none = F.create_map().cast("map<string,string>")
    return responses.join(maps.select("query_id", "citations"), "query_id", "left").withColumn(
        text, policy.resolve_placeholders(F.col(text), F.coalesce("citations", none))).drop("citations")


def _provision_block() -> Column:
    return F.concat(
        F.lit(P.PROVISION_BLOCK[0]), F.col("chunk_id").cast("string"), F.lit(P.PROVISION_BLOCK[1]), F.col("hierarchy_path"),
        F.lit(P.PROVISION_BLOCK[2]), F.col("content"), F.lit(P.PROVISION_BLOCK[3]),
        F.col("chunk_id").cast("string"), F.lit(P.PROVISION_BLOCK[4]))


def _question_block() -> Column:
    return F.concat(F.lit(P.QUESTION_BLOCK[0]), F.col("query_text"), F.lit(P.QUESTION_BLOCK[1]))


def assemble_context(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, context, question, input_tokens): ranked chunks as fenced blocks."""
    blocks = hits.select("query_id", F.struct("rank", _provision_block().alias("block")).alias("b")).groupBy("query_id").agg(
        F.array_sort(F.collect_list("b")).alias("b"))
    joined = F.array_join(F.transform("b", lambda b: b["block"]), _BETWEEN)
    rows = queries.select("query_id", _question_block().alias("question")).join(
        blocks.select("query_id", joined.alias("context")), "query_id", "left").withColumn(
        "context", F.coalesce("context", F.lit("")))
    return rows.withColumn("input_tokens", token_count(F.concat("context", "question"), floor=0))


def prompt_tokens(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, input_tokens) of ``assemble_context`` from the lengths of the blocks alone.

    Joined with texts, a side that is small until its blocks are built would be broadcast as a whole.
    """
    sizes = hits.select("query_id", F.length(_provision_block()).cast("bigint").alias("size")).groupBy("query_id").agg(
        (F.sum("size") + len(_BETWEEN) * (F.count("size") - 1)).alias("context"))
    rows = queries.select("query_id", F.length(_question_block()).alias("question")).join(sizes, "query_id", "left")
    return rows.select("query_id", token_count_of_length(F.coalesce("context", F.lit(0)) + F.col("question"), floor=0).alias("input_tokens"))


def fail_open(hits: DataFrame, contexts: DataFrame, languages: DataFrame) -> DataFrame:
    """(query_id, answer): the found chunks themselves, each with its citation if its act is known."""
    known = contexts.join(languages.select("query_id", "language"), "query_id").select(
        "query_id", "chunk_id", policy.format_citation(F.struct(*_CONTEXT), F.col("language")).alias("citation"))
    lines = hits.select("query_id", "chunk_id", "rank", "content").join(known, ["query_id", "chunk_id"], "left")
    line = F.concat(F.lit("\n"), F.col("content"), F.coalesce(F.concat(F.lit(" ["), "citation", F.lit("]")), F.lit("")))
    sorted_lines = lines.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    found = sorted_lines.select("query_id", F.array_join(F.concat(
        F.array(F.lit(P.FAIL_OPEN_HEADER)), F.transform("l", lambda x: x["line"])), "\n").alias("answer"))
    return languages.select("query_id").join(found, "query_id", "left").withColumn(
        "answer", F.coalesce("answer", F.lit(P.FAIL_OPEN_HEADER)))


def texts_by_language(texts: dict[str, dict[str, str]], version: str, language: Column) -> Column:
    """A versioned text in the response's language; an unknown version is an error."""
    if version not in texts:
        raise KeyError(f"unknown version: {version!r}")
    return F.when(language == "bn", texts[version]["bn"]).otherwise(texts[version]["en"])


def response_path(cached: Column, intent: Column, has_section_list: Column, decline_reason: Column,
                  over_ceiling: Column, provider_failed: Column, violations: Column) -> Column:
    """Which of the fixed steps answers a question; the first that applies wins."""
    return (F.when(cached, "cache_hit")
            .when((intent == "section_list") & has_section_list, "section_list")
            .when(decline_reason.isNotNull(), "declined")
            .when(over_ceiling, "cost_refused")
            .when(provider_failed, "provider_failed")
            .when(violations >= 2, "guardrail_failed")
            .otherwise("answered"))


DEGRADED_PATHS = ["cost_refused", "provider_failed", "guardrail_failed"]


def respond(queries: DataFrame, hits: DataFrame, contexts: DataFrame, responses: DataFrame,
            disclaimers: dict, declines: dict, settings: Settings = Settings(),
            cache: DataFrame | None = None, section_lists: DataFrame | None = None,
            model: str = "model", reranker: str = "reranker") -> DataFrame:
    """One finished response per query.

    queries: query_id, query_text, detected_language, as_of, act_ids. hits: ranked, with
    act_id, hierarchy_path and content. responses: query_id, text, retry_text, failed: what a
    model answered, and answered when asked again. cache: key, text. section_lists: act_id,
    text. Every path ends in the active disclaimer.
    """
    q = queries.withColumns({
        "language": response_language(F.col("detected_language")),
        "intent": policy.classify_intent(F.col("query_text"))})
    q = q.withColumn("family", policy.prompt_family(F.col("intent"), settings.prompt_version))
    ranked = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("chunk_id").cast("string").alias("id")))).alias("h"),
        F.max_by("score", -F.col("rank")).alias("top_score"))
    languages = q.select("query_id", "language")
    maps = citation_maps(contexts, languages)
    prompts = prompt_tokens(hits, q)
    opened = fail_open(hits, contexts, languages).withColumnRenamed("answer", "fail_open")
    rows = q
    for side in (ranked, maps, prompts, responses):
        rows = rows.join(side, "query_id", "left")
    ids = F.coalesce(F.transform("h", lambda x: x["id"]), F.array().cast("array<string>"))
    rows = rows.withColumn("cache_key", cache_key(
        F.col("query_text"), ids, F.col("as_of"), model, F.col("family.version"), reranker))
    if cache is None:
        rows = rows.withColumn("cached_text", F.lit(None).cast("string"))
    else:
        rows = rows.join(cache.select(F.col("key").alias("cache_key"), F.col("text").alias("cached_text")), "cache_key", "left")
    rows = rows.withColumn("_act", F.get("act_ids", F.lit(0)))
    if section_lists is None:
        rows = rows.withColumn("section_list", F.lit(None).cast("string"))
    else:
        rows = rows.join(section_lists.select(F.col("act_id").alias("_act"), F.col("text").alias("section_list")), "_act", "left")
    # The chunks' texts come last: no other join moves them.
    rows = rows.join(opened, "query_id", "left")

    first, second = policy.guardrail(F.col("text")), policy.guardrail(F.col("retry_text"))
    rows = rows.withColumns({
        "decline_reason": policy.decline_reason(F.col("query_text"), F.col("top_score"), F.col("intent"), settings),
        "projected_cost": policy.projected_cost(F.col("input_tokens"), settings),
        "_violations": F.when(first.isNull(), 0).when(second.isNull(), 1).otherwise(2),
        "_raw": F.when(first.isNull(), F.col("text")).otherwise(F.col("retry_text"))})
    failed = F.coalesce("failed", F.lit(True)) | F.col("_raw").isNull()
    rows = rows.withColumn("path", response_path(
        F.col("cached_text").isNotNull(), F.col("intent"), F.col("section_list").isNotNull(),
        F.col("decline_reason"), policy.over_ceiling(F.col("input_tokens"), settings), failed, F.col("_violations")))
    disclaimer = texts_by_language(disclaimers, settings.disclaimer_version, F.col("language"))
    decline = texts_by_language(declines, settings.decline_version, F.col("language"))
    citations = F.coalesce("citations", F.create_map().cast("map<string,string>"))
    body = (F.when(F.col("path") == "section_list", F.col("section_list"))
            .when(F.col("path") == "declined", decline)
            .when(F.col("path").isin(DEGRADED_PATHS), F.col("fail_open"))
            .otherwise(policy.strip_filler(policy.resolve_placeholders(F.col("_raw"), citations))))
    answer = F.when(F.col("path") == "cache_hit", policy.refresh_disclaimer(F.col("cached_text"), disclaimer)).otherwise(
        policy.append_disclaimer(body, disclaimer))
    no_ids = F.array().cast("array<string>")
    return rows.select(
        "query_id", "intent", "path", answer.alias("answer"),
        F.when(F.col("path").isin("section_list", "declined"), no_ids).otherwise(
            F.coalesce("cited", no_ids)).alias("citations"),
        (F.col("path") == "cache_hit").alias("cached"), (F.col("path") == "declined").alias("declined"),
        F.col("path").isin(DEGRADED_PATHS).alias("degraded"), "decline_reason",
        F.col("projected_cost").cast("decimal(10,6)").alias("cost_usd"), "cache_key",
        F.lit(settings.disclaimer_version).alias("disclaimer_version"))
