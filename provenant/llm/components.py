"""Connected components of an undirected graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from provenant.plans.session import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the least node of its component.

    Large and small stars in turn: each node's larger neighbours, then its smaller ones, are attached to the least of its
    neighbourhood, until nothing changes. That takes about the logarithm of the longest path in rounds. A node's
    neighbourhood is never gathered: its least is an aggregate with a map-side part, joined back to the edges.
    """
    rows = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    nodes = stored(rows.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    before = None
    while True:
        both = rows.union(rows.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = stored(large)
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(down, "a")
        small = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(moved.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        rows = stored(small)
        # Equal sums of hashes of both rounds: nothing moved.
        state = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        now = (state["n"], state["h"])
        if now == before:
            break
        before = now
    roots = rows.groupBy("a").agg(F.min("b").alias("root"))
    return nodes.join(roots, nodes["node"] == roots["a"], "left").select("node", F.coalesce("root", "node").alias("root"))
