"""Columns and table helpers that several of these operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: White space between words: ASCII only, so that bytes, code points and SQL engines agree.
SPACES = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The runs of other characters than ASCII white space, in order; none for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(rows: DataFrame, store, *order: Column, name: str = "number") -> DataFrame:
    """Number all rows from 0 in a global order without gathering them in one task.

    Rows are range-partitioned and written once (``store``), so that partition borders stay put;
    a partition's offset is the count of rows before it.
    """
    placed = store(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (placed.withColumn("_inside", inside).join(offsets, "_part")
            .withColumn(name, F.col("_before") + F.col("_inside") - 1).drop("_part", "_before", "_inside"))
