"""Helpers that keep a hot key from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread_by: Sequence[str],
                salts: int, how: str = "inner") -> DataFrame:
    """Equi-join whose big side may hold one key in a third of its rows.

    The big side is split by a hash of ``spread_by``; each small row is repeated once per
    salt. ``how`` is inner, left or left_semi, as seen from the big side.
    """
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def top_per_group(rows: DataFrame, group: Sequence[str], order: Sequence[Column], n: int,
                  rank: str = "rank") -> DataFrame:
    """First n rows per group with their rank; tasks prune to n before anything is shuffled."""
    ranked = rows.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col(rank) <= n)


def running_number(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], slab: Column,
                   name: str) -> DataFrame:
    """row_number over ``keys``, split by ``slab`` so that no task holds a whole hot key.

    ``slab`` must not decrease along ``order``. Counts per slab give the offset of each.
    """
    rows = rows.withColumn("_slab", slab)
    counts = rows.groupBy(*keys, "_slab").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slab").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_slab", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_slab").orderBy(*order)
    numbered = rows.withColumn("_rn", F.row_number().over(inside)).join(offsets, [*keys, "_slab"])
    return numbered.withColumn(name, F.col("_before") + F.col("_rn")).drop("_before", "_rn", "_slab")
