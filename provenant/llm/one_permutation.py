"""Document fingerprints by one-permutation MinHash.

A text's shingles of five words are hashed once. The top bits of a hash name one of BINS bins, and each bin keeps
its least hash. An empty bin borrows from a bin that every text with the same filled bins would choose (optimal
densification: of the filled bins, the one that a hash of the pair of bins ranks first). The low-order BITS of
each bin's value are stored as hexadecimal text. Two fingerprints' likeness is the share of equal bins, corrected
for the bins whose low bits agree by chance.

All of it is array expressions: hashes and one placeholder per bin are sorted together, so that a bin's least
hash is the first of its run, and no row ever leaves its partition.

Cases: a text with one to four words has one shingle, its whole sequence. A null text counts as empty; an empty text
has the empty fingerprint, which is like itself only. Letters A-Z count as small. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from provenant.llm.base import lower_ascii, words

BIN_BITS, BITS, SHINGLE = 7, 8, 5
BINS = 1 << BIN_BITS
_SHIFT = 63 - BIN_BITS
_TOP = (1 << _SHIFT) - 1


def values_sql(tokens: str) -> str:
    """SQL: the BINS low-order values, less 128, of the array of words ``tokens``; empty without words.

    ``transform(array(x), y -> ...)[0]`` names x, so that it is computed once.
    """
    window = ", ".join(f"element_at({tokens}, i + {k})" for k in range(SHINGLE))
    hashes = (f"if(size({tokens}) < {SHINGLE}, array(shiftrightunsigned(xxhash64({tokens}), 1)), "
              f"transform(sequence(1, size({tokens}) - {SHINGLE - 1}), i -> shiftrightunsigned(xxhash64({window}), 1)))")
    placeholders = f"transform(sequence(0, {BINS - 1}), i -> shiftleft(cast(i as bigint), {_SHIFT}) + {_TOP}L)"
    least = (f"transform(array(sort_array(concat({hashes}, {placeholders}))), r -> filter(r, (x, i) -> i = 0 or "
             f"shiftright(x, {_SHIFT}) <> shiftright(get(r, i - 1), {_SHIFT})))[0]")
    borrowed = f"array_min(transform(f, p -> struct(xxhash64(i, shiftright(p, {_SHIFT})) as rank, p as value))).value"
    dense = (f"transform(array({least}), m -> transform(array(filter(m, x -> (x & {_TOP}L) <> {_TOP}L)), f -> "
             f"transform(m, (x, i) -> cast((if((x & {_TOP}L) <> {_TOP}L, x, {borrowed}) & {(1 << BITS) - 1}) - 128 as tinyint)))[0])[0]")
    return f"if(size({tokens}) = 0, cast(array() as array<tinyint>), {dense})"


def packed(values: Column) -> Column:
    """Hexadecimal text of the values."""
    return F.lower(F.array_join(F.transform(values, lambda x: F.lpad(F.hex(x.cast("int") + 128), BITS // 4, "0")), ""))


def likeness(left: Column, right: Column) -> Column:
    """Estimated Jaccard similarity of two texts from their values, 0 to 1."""
    equal = F.size(F.filter(F.zip_with(left, right, lambda a, b: a == b), lambda x: x)) / float(BINS)
    chance = 2.0 ** -BITS
    estimate = F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), (F.size(left) == F.size(right)).cast("double")).otherwise(estimate)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (null as empty) and its values."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.withColumn("w", words(lower_ascii(F.col("text")))).select("doc_id", "text", F.expr(values_sql("w")).alias("values"))


def beside_next(rows: DataFrame, columns: Sequence[str], rows_per_block: int = 1000, max_blocks: int = 10_000) -> DataFrame:
    """Add next_<column>: the columns of the following row in descending doc_id, after the last those of the first.

    doc_id is a number. Rows are dealt into blocks of neighbouring ids, bounded by quantiles that are ids of the table, so
    that no task sees the whole order. A block's last row finds its successor as a guest: the rows that
    hold a bound are also sent to the block above, and the rows of the largest id to the lowest block. Null ids come
    last; rows that repeat an id are ordered by their text.
    """
    blocks = max(1, min(max_blocks, rows.count() // rows_per_block))
    cuts = F.array(*[F.lit(i / blocks) for i in range(1, blocks)]) if blocks > 1 else None
    found = rows.agg(F.max("doc_id").alias("top"), *([F.percentile_approx("doc_id", cuts, 10 * blocks).alias("cuts")] if cuts is not None else [])).first()
    if found["top"] is None:
        bounds = []
    else:
        bounds = sorted({*(found["cuts"] if cuts is not None else []), found["top"]})
    listed = f"array({', '.join(f'{x}L' for x in bounds)})" if bounds else "cast(array() as array<bigint>)"
    # Binary search for the number of bounds below the id.
    below = (f"aggregate(sequence({max(1, len(bounds)).bit_length() - 1}, 0, -1), 0, (at, bit) -> "
             f"if(coalesce(get({listed}, at + shiftleft(1, bit) - 1) < doc_id, false), at + shiftleft(1, bit), at))")
    rows = rows.withColumn("_at", F.expr(below))
    is_bound = F.expr(f"coalesce(get({listed}, _at) = doc_id, false)")
    upper = F.when(F.col("_at") == max(0, len(bounds) - 1), 0).otherwise(F.col("_at") + 1)
    if bounds:
        seats = F.array(F.struct(F.col("_at").alias("block"), F.lit(0).alias("guest")),
                        F.when(is_bound, F.struct(upper.cast("int").alias("block"), F.lit(1).alias("guest"))))
    else:  # null ids only: the first of them is also their guest
        seats = F.array(F.struct(F.lit(0).alias("block"), F.lit(0).alias("guest")), F.struct(F.lit(0).alias("block"), F.lit(1).alias("guest")))
    rows = rows.withColumn("_seat", F.explode(F.filter(seats, lambda x: x.isNotNull()))).drop("_at")
    order = Window.partitionBy("_seat.block").orderBy("_seat.guest", F.col("doc_id").desc_nulls_last(), "text")
    rows = rows.withColumns({f"next_{name}": F.lead(name).over(order) for name in columns})
    return rows.filter("_seat.guest = 0").drop("_seat")


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its fingerprint, that of an edited text, and its likeness to that and to the next document.

    The edited text has its last third of code points replaced by the first as many of the next document.
    """
    rows = beside_next(fingerprints(docs, id_col, text_col), ["text", "values"])
    rows = rows.withColumn("n_chars", F.length("text")).withColumn("third", F.floor(F.col("n_chars") / 3).cast("int"))
    edited = F.expr("concat(substring(text, 1, n_chars - third), substring(next_text, 1, third))")
    rows = rows.withColumn("edited", edited).withColumn("w", words(lower_ascii(F.col("edited"))))
    rows = rows.withColumn("edited_values", F.expr(values_sql("w")))
    return rows.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       packed(F.col("values")).alias("fingerprint"), packed(F.col("edited_values")).alias("edited_fingerprint"),
                       likeness(F.col("values"), F.col("edited_values")).alias("near_edited"),
                       likeness(F.col("values"), F.col("next_values")).alias("near_next"))
