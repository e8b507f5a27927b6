"""Retrieval and answer metrics over a golden set, with breakdowns and gates."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from provenant.functions import distance, policy
from provenant.plans.skew import top_per_group

# Gated metrics and their least acceptable value; label of records without act.
THRESHOLDS = {"section_citation_accuracy": 0.85, "language_routing_accuracy": 0.95, "decline_accuracy": 0.95}
NO_ACT = "__no_act__"
RECALL_K = 5
METRICS = ["section_citation_accuracy", f"context_recall_at_{RECALL_K}", "language_routing_accuracy",
           "decline_accuracy", "answer_edit_distance"]


def pair_results(golden: DataFrame, results: DataFrame) -> DataFrame:
    """Golden records with their results; a record without a result gets a neutral one."""
    return golden.join(results, "id", "left").withColumns({
        "detected_language": F.coalesce("detected_language", F.lit("en")),
        "declined": F.coalesce("declined", F.lit(False)),
        "retrieved_sections": F.coalesce("retrieved_sections", F.array().cast("array<string>")),
        "answer": F.coalesce("answer", F.lit(""))})


def similarity(reference: Column, answer: Column) -> Column:
    """1 less the edit distance of two whole texts as a share of the longer one; two empty texts are equal."""
    longest = F.greatest(F.length(reference), F.length(answer))
    return 1 - F.coalesce(distance.edit_distance(reference, answer) / F.nullif(longest, F.lit(0)), F.lit(0.0))


_ELIGIBLE = "not should_decline and expected_section is not null"


def _share(hit: Column, eligible: Column | None = None) -> Column:
    value = hit.cast("double")
    return F.coalesce(F.avg(value if eligible is None else F.when(eligible, value)), F.lit(1.0))


def section_accuracy() -> Column:
    top = F.get("retrieved_sections", F.lit(0))
    return _share(F.coalesce(top == F.col("expected_section"), F.lit(False)), F.expr(_ELIGIBLE))


def recall_at_k(k: int = RECALL_K) -> Column:
    return _share(F.array_contains(F.slice("retrieved_sections", 1, k), F.col("expected_section")), F.expr(_ELIGIBLE))


def routing_accuracy() -> Column:
    return _share(F.col("detected_language") == F.col("language"))


def decline_accuracy() -> Column:
    return _share(F.col("declined") == F.col("should_decline"))


def with_distance(pairs: DataFrame) -> DataFrame:
    """Add ``distance`` of answered records that have a reference; Python sees only the two texts of these."""
    eligible = ~F.col("declined") & F.col("reference_summary").isNotNull()
    return pairs.withColumn("distance", F.when(eligible, 1 - similarity(
        F.when(eligible, F.col("reference_summary")), F.when(eligible, F.col("answer")))))


def metric_columns() -> list[Column]:
    columns = [section_accuracy(), recall_at_k(), routing_accuracy(), decline_accuracy(),
               F.coalesce(F.avg("distance"), F.lit(0.0))]
    return [c.alias(name) for c, name in zip(columns, METRICS)]


def metrics(pairs: DataFrame) -> DataFrame:
    """One row with all metrics and the number of records."""
    return with_distance(pairs).agg(*metric_columns(), F.count(F.lit(1)).alias("n"))


def breakdown(pairs: DataFrame) -> DataFrame:
    """The same accuracies per act, per language and overall, in one pass over the pairs."""
    # Grouped columns are null outside their own slice, so routing is judged before grouping.
    labelled = pairs.withColumns({"act": F.coalesce("act_slug", F.lit(NO_ACT)),
                                  "routed": F.col("detected_language") == F.col("language")})
    sets = labelled.groupingSets([[F.col("act")], [F.col("language")], []], F.col("act"), F.col("language"))
    rows = sets.agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"),
        section_accuracy().alias(METRICS[0]), _share(F.col("routed")).alias(METRICS[2]), decline_accuracy().alias(METRICS[3]))
    slice_by = F.when(F.col("_g") == 1, "act").when(F.col("_g") == 2, "language").otherwise("all")
    return rows.select(slice_by.alias("slice_by"), F.coalesce("act", "language", F.lit("all")).alias("slice"),
                       "n", METRICS[0], METRICS[2], METRICS[3])


def gate(measured: DataFrame, thresholds: Mapping[str, float] = THRESHOLDS) -> DataFrame:
    """(metric, value, threshold, passed, all_passed) per gated metric; a missing one counts 0."""
    held = {name for name in thresholds if name in measured.columns}
    value = lambda name: F.coalesce(F.col(name), F.lit(0.0)) if name in held else F.lit(0.0)
    everything = reduce(lambda a, b: a & b, [value(n) >= t for n, t in thresholds.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), value(n).alias("value"), F.lit(float(t)).alias("threshold"),
                              (value(n) >= t).alias("passed"), everything.alias("all_passed"))
                     for n, t in thresholds.items()])
    return measured.select(F.inline(rows))


def compare_runs(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(prompt_version, metric, value, previous, delta) for runs of the same version."""
    flat = lambda runs, name: runs.select("prompt_version", F.explode("metrics").alias("metric", name))
    both = flat(current, "value").join(flat(previous, "previous"), ["prompt_version", "metric"], "left")
    return both.withColumn("delta", F.col("value") - F.col("previous"))


def sample_eval(chunks: DataFrame, acts: DataFrame, n: int, seed: int, pools: DataFrame | None = None,
                label: str = "Section") -> DataFrame:
    """Up to n chunks per act and language whose path names a section, as golden records.

    The order is a seeded hash of the chunk id, so a seed always draws the same chunks. Pool
    records, if given, are appended as they are.
    """
    named = chunks.filter(F.col("hierarchy_path").contains(label))
    drawn = top_per_group(named, ["act_id", "language"], [F.sha2(F.concat_ws("|", F.lit(seed), F.col("id").cast("string")), 256), F.asc("id")], n, "_n")
    # A drawn chunk without a readable number is dropped, not replaced.
    rows = drawn.withColumn("expected_section", policy.first_section(F.col("hierarchy_path"))).filter(
        "expected_section is not null")
    named_acts = acts.select(F.col("id").alias("act_id"), F.col("slug").alias("act_slug"), F.col("full_name_en").alias("expected_act"))
    records = rows.join(named_acts, "act_id").select(
        F.concat_ws("-", "act_slug", "language", F.lit("gen"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 6)).alias("id"),
        "language", "act_slug", F.col("content").alias("source_text"), "expected_act", "expected_section",
        F.lit(True).alias("must_cite"), F.lit("factual").alias("category"), F.lit(False).alias("should_decline"))
    return records if pools is None else records.unionByName(pools, allowMissingColumns=True)
