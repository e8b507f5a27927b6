"""From documents to packed training sequences.

Stages, in order: reject text of low quality, keep one document of each group of near duplicates, replace personal
data by pseudonyms, mix the sources to their weights, pack the tokens. All but the last return the columns of
``documents``.

Rows with the same doc_id, or without one, are kept apart; the second stage goes by their texts. The fourth treats rows
without an id as sharing one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from provenant.llm import fair_queue, harmonic, kneser_ney, pseudonyms, signature_tree
from provenant.llm.queries import PSEUDONYM_KEY, table
from provenant.plans.session import configure, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts."""
    model = kneser_ney.fit(docs, table(spark, sf_dir, "labels"))
    return kneser_ney.score(docs, model).filter("accepted").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts one row, that with the least id; rows without words are all kept."""
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"))
    # Rows of equal sets are reduced to one in the map tasks.
    one = docs.filter(worded).withColumn("_class", signature_tree.class_column("text")).groupBy("_class").agg(F.min_by(row, order).alias("_first"))
    chosen = signature_tree.chosen_classes(docs).withColumnRenamed("class", "_class")
    return one.join(chosen, "_class", "left_semi").select("_first.*").union(docs.filter(~worded))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced."""
    changed = pseudonyms.pseudonymize(docs, PSEUDONYM_KEY, count_col="_replaced")
    return changed.withColumn("n_chars", F.when(F.col("_replaced") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = fair_queue.mix(docs).select("doc_id", "size", F.expr("if(size = 0, 0, cast(taken / size as int))").alias("_copies"))
    place = Window.partitionBy("doc_id").orderBy("_size")
    taken = (mixed.withColumnRenamed("size", "_size").withColumn("_row", F.row_number().over(place.orderBy("_size", F.desc("_copies"))))
             .select(F.col("doc_id").alias("_id"), "_row", "_copies").filter("_copies > 0"))
    rows = docs.withColumn("_size", fair_queue.word_count(F.col("text"))).withColumn("_row", F.row_number().over(place))
    rows = rows.join(taken, rows["doc_id"].eqNullSafe(taken["_id"]) & (rows["_row"] == taken["_row"]))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences."""
    return harmonic.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mixture),
    ("packing", packing),
]

#: SQL cannot express the classifier, the pseudonyms or the tokenizer; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
