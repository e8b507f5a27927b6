"""Explicit schemas of the corpus and log tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, null) for name, kind, null in fields])


S, I, D, TS, B = (T.StringType(), T.IntegerType(), T.DateType(), T.TimestampType(),
                  T.BooleanType())
STRINGS = T.ArrayType(S)

# Fixed vocabularies of the enumerated columns.
ACT_STATUSES = ["in_force", "partially_repealed", "repealed"]
PROVISION_KINDS = ["part", "chapter", "section", "subsection", "clause"]
RUN_STATUSES = ["running", "succeeded", "failed"]
TIERS = ["HIGH", "MEDIUM", "LOW"]
RATINGS = ["helpful", "not_helpful", "wrong_citation", "out_of_scope"]
LANGUAGES = ["bn", "en"]

ACTS = _struct(
    ("id", S, False), ("slug", S, False), ("short_name", S, False),
    ("full_name_en", S, False), ("full_name_bn", S, False), ("act_number", S, False),
    ("act_year", I, False), ("ministry", S, True), ("status", S, False),
    ("created_at", TS, False))

PROVISIONS = _struct(
    ("id", S, False), ("act_id", S, False), ("parent_id", S, True), ("kind", S, False),
    ("number", S, False), ("title", S, True), ("sort_path", S, False))

REVISIONS = _struct(
    ("id", S, False), ("provision_id", S, False), ("language", S, False),
    ("translation_status", S, False), ("text", S, False), ("effective_from", D, False),
    ("effective_to", D, True), ("amending_act_id", S, True), ("provenance", S, True),
    ("content_hash", S, False), ("source_url", S, False), ("fetched_at", TS, False))

CHUNKS = _struct(
    ("id", S, False), ("revision_id", S, False), ("provision_id", S, False),
    ("act_id", S, False), ("chunk_index", I, False), ("language", S, False),
    ("hierarchy_path", S, False), ("content", S, False), ("tokens", STRINGS, False),
    ("token_count", I, False), ("embedding", T.ArrayType(T.FloatType()), True),
    ("metadata", T.MapType(S, S), True), ("created_at", TS, True))

RUNS = _struct(
    ("id", S, False), ("act_id", S, False), ("language", S, False), ("status", S, False),
    ("started_at", TS, False), ("finished_at", TS, True), ("provisions_processed", I, True),
    ("chunks_created", I, True), ("error", S, True))

QUERIES = _struct(
    ("id", S, False), ("correlation_id", S, True), ("detected_language", S, False),
    ("selected_language", S, False), ("act_ids", STRINGS, False), ("as_of_date", D, True),
    ("query_text", S, False), ("retrieved_chunk_ids", STRINGS, False),
    ("rerank_top_score", T.DecimalType(6, 4), True), ("declined", B, False),
    ("decline_reason", S, True), ("confidence_tier", S, False), ("degraded", B, False),
    ("response_text", S, True), ("provider", S, True), ("prompt_version", S, True),
    ("disclaimer_version", S, False), ("tokens_in", I, True), ("tokens_out", I, True),
    ("cost_usd", T.DecimalType(10, 6), True), ("cached", B, False), ("latency_ms", I, True),
    ("ip_hash", S, True), ("created_at", TS, False))

FEEDBACK = _struct(
    ("id", S, False), ("query_id", S, False), ("rating", S, False), ("comment", S, True),
    ("created_at", TS, False))

GOLDEN = _struct(
    ("id", S, False), ("language", S, False), ("act_slug", S, True), ("question", S, False),
    ("expected_act", S, True), ("expected_section", S, True), ("expected_subsection", S, True),
    ("reference_summary", S, True), ("must_cite", B, False), ("category", S, True),
    ("should_decline", B, False), ("as_of_date", D, True))

TABLES = {
    "acts": ACTS, "provisions": PROVISIONS, "provision_revisions": REVISIONS, "chunks": CHUNKS,
    "ingestion_runs": RUNS, "queries": QUERIES, "feedback": FEEDBACK}

# Columns with a closed vocabulary, for the quality filter.
CHECKS = {
    "acts": {"status": ACT_STATUSES},
    "provisions": {"kind": PROVISION_KINDS},
    "provision_revisions": {"language": LANGUAGES},
    "chunks": {"language": LANGUAGES},
    "ingestion_runs": {"status": RUN_STATUSES, "language": LANGUAGES},
    "queries": {"confidence_tier": TIERS},
    "feedback": {"rating": RATINGS}}
