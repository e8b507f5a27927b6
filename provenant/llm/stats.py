"""Statistics of a text that the quality rules test, as columns.

A null or empty text has zeros everywhere. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from provenant.llm.base import words

#: Low bits of a window's key that hold its position: texts of up to 16 million words.
PLACE_BITS = 24


def repeated_words(tokens: str, hashes: str, window: int = 5) -> str:
    """SQL: words inside windows that occur at least twice in the array ``tokens``.

    ``hashes`` has one hash per window. Windows are ordered by hash and position; neighbours with equal hashes count
    only if their words are equal, so a collision of hashes adds nothing. The lengths that the repeated windows cover
    are then summed without overlap. ``transform(array(x), y -> ...)[0]`` names x, so that it is computed once.
    """
    mask = (1 << PLACE_BITS) - 1
    ordered = f"sort_array(transform({hashes}, (x, i) -> shiftleft(shiftright(x, {PLACE_BITS}), {PLACE_BITS}) + i + 1))"

    def equal(other: str) -> str:
        return (f"coalesce(shiftright(x, {PLACE_BITS}) = shiftright({other}, {PLACE_BITS}) AND "
                f"slice({tokens}, cast(x & {mask} as int), {window}) = slice({tokens}, cast({other} & {mask} as int), {window}), false)")

    starts = (f"transform(array({ordered}), keys -> filter(transform(keys, (x, j) -> "
              f"if({equal('get(keys, j - 1)')} OR {equal('get(keys, j + 1)')}, x & {mask}, 0L)), p -> p > 0))[0]")
    return (f"transform(array(sort_array({starts})), s -> aggregate(transform(s, (p, j) -> "
            f"least({window}L, coalesce(get(s, j + 1) - p, {window}L))), 0L, (a, b) -> a + b))[0]")


def with_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of its text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), words(F.col(text_col)).alias("w"))
    windows = "transform(sequence(1, size(w) - 4), i -> xxhash64(element_at(w, i), element_at(w, i + 1), element_at(w, i + 2), element_at(w, i + 3), element_at(w, i + 4)))"
    rows = rows.withColumn("h", F.when(F.size("w") >= 6, F.expr(windows)))
    has_repeat = F.col("h").isNotNull() & (F.size(F.array_distinct("h")) < F.size("h"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    next_to_same = F.size(F.filter(F.zip_with(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), "w", lambda a, b: a == b), lambda x: x))
    rows = rows.withColumn("lines", lines)
    length = F.length("text")

    def count_of(characters: str) -> Column:
        return (length - F.length(F.translate("text", characters, ""))).cast("long")

    return rows.select(
        "doc_id", F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        count_of("#*$%&|<>").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(has_repeat, F.expr(repeated_words("w", "h"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.coalesce(next_to_same, F.lit(0)).cast("long").alias("n_stutters"),
        count_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        count_of("!").alias("n_exclaims"), count_of("0123456789").alias("n_digits"), F.size("lines").cast("long").alias("n_lines"))
