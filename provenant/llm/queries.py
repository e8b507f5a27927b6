"""The registered queries of this subpackage, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from provenant.llm import crf, decision_list, fair_queue, harmonic, kneser_ney, one_permutation, periodic, pivots, pseudonyms, signature_tree, tag_paths, token_counts, transducer
from provenant.llm.base import words
from provenant.plans.session import configure

#: The test tables' key; a deployment passes its own secret.
PSEUDONYM_KEY = "test tables"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_harmonic_packing(spark: SparkSession, folder: str) -> DataFrame:
    return harmonic.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_signature_tree(spark: SparkSession, folder: str) -> DataFrame:
    return signature_tree.link(table(spark, folder, "documents"))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_crf(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = crf.predict(docs, crf.fit(docs))
    return found.select("doc_id", F.coalesce(crf.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    return pseudonyms.pseudonymize(table(spark, folder, "documents"), PSEUDONYM_KEY).select("doc_id", "text", "n_replaced")


def op6_decision_list(spark: SparkSession, folder: str) -> DataFrame:
    judged, _ = decision_list.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op7_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = kneser_ney.fit(docs, table(spark, folder, "labels"))
    return kneser_ney.score(docs, model).select("doc_id", "n_tokens", "perplexity", "threshold", "accepted")


def op8_fair_queue(spark: SparkSession, folder: str) -> DataFrame:
    return fair_queue.mix(table(spark, folder, "documents")).drop("source")


def op9_one_permutation(spark: SparkSession, folder: str) -> DataFrame:
    return one_permutation.compare(table(spark, folder, "documents"))


def op10_tag_paths(spark: SparkSession, folder: str) -> DataFrame:
    return tag_paths.extract(table(spark, folder, "pages"))


def with_periods(docs: DataFrame) -> DataFrame:
    """One document in ten repeats its own words from some place on, with a period drawn from its id."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    own, n = F.col("_words"), F.size("_words").cast("long")
    g = F.floor(h / 10)
    repeated = F.transform(own, lambda w, i: F.when(i < F.col("_a"), w).otherwise(own[(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")]))
    # Only these documents' words are split here; the others' arrays are empty.
    drawn = docs.select("doc_id", "text", F.when(h % 10 == 0, words(F.col("text"))).otherwise(F.array().cast("array<string>")).alias("_words"), g.alias("_g"))
    placed = drawn.withColumn("_a", F.when(n > 0, F.col("_g") % n)).withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8)))
    return placed.select("doc_id", F.when(n > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.detect(with_periods(table(spark, folder, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    top = found.withColumn("top", periodic.longest(F.col("runs")))
    return top.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), F.col("top.length").alias("length"),
                      F.col("top.period").alias("period"), F.floor(F.col("top.length") * 1000 / F.col("top.period")).cast("long").alias("exponent_milli"),
                      F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_pivot_table(spark: SparkSession, folder: str) -> DataFrame:
    return pivots.report(pivots.cluster(table(spark, folder, "embeddings")))


def op13_merge_transducer(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = transducer.round_trip(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_harmonic_packing": op1_harmonic_packing,
    "op2_signature_tree": op2_signature_tree,
    "op3_token_counts": op3_token_counts,
    "op4_crf": op4_crf,
    "op5_pseudonyms": op5_pseudonyms,
    "op6_decision_list": op6_decision_list,
    "op7_kneser_ney": op7_kneser_ney,
    "op8_fair_queue": op8_fair_queue,
    "op9_one_permutation": op9_one_permutation,
    "op10_tag_paths": op10_tag_paths,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_pivot_table": op12_pivot_table,
    "op13_merge_transducer": op13_merge_transducer,
}

SQL: dict[str, str] = {"op2_signature_tree": signature_tree.LINK_SQL, "op8_fair_queue": fair_queue.MIX_SQL, "op12_pivot_table": pivots.CLUSTER_SQL}
