"""Mixing sources to target weights by weighted fair queueing.

Every document gets a virtual finish time: the tokens of its source up to and including it, in shuffled
order, divided by the source's target. All copies of all sources then form one queue by finish time,
which is cut at the total budget. A source may be walked up to ``max_repeats`` times.

Nothing holds a whole source: the running sum of a source is split by hash bucket, the cut is found from a
histogram of finish times, and only the bucket of the histogram that holds the cut is ordered.

Cases: a null or empty text has size 0 and takes part with nothing taken. A null source is a source of its own,
last in order. Equal finish times are ordered by the document's hash, then its id. Rows that repeat a doc_id are
separate documents. An empty table gives an empty result. Only the named columns are read, so extra ones cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from provenant.llm.base import SPACES, numbered
from provenant.plans.session import stored

#: Finish times are counted in steps of 1 / STEPS up to HORIZON; at 1 every source has reached its target.
STEPS, HORIZON = 4096, 8


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACES.replace("[", "[^"))), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], max_repeats: int, budget: int | None = None) -> DataFrame:
    """Per source its size, weight and target; ``sizes`` has source and size per document.

    Weights repeat along the sources' code-point order. A target stops at ``max_repeats`` times the source's size;
    what that leaves is shared again by weight until no target is above its stop.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(totals, stored, F.col("source").asc_nulls_last(), name="place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = stored(ranked.withColumn("weight", weight).drop("place"))
    stop = F.col("source_size") * max_repeats
    level = None
    while True:
        full = F.lit(False) if level is None else stop < F.col("weight") * F.lit(level)
        got = ranked.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, stop)).alias("stopped"),
                         F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        total = budget if budget is not None else got["all"] or 0
        if not got["open"]:
            break
        following = float(total - (got["stopped"] or 0)) / float(got["open"])
        if following == level:
            break
        level = following
    share = F.lit(0.0) if level is None else F.col("weight") * F.lit(level)
    return ranked.withColumn("target", F.least(stop.cast("double"), share)).select("source", "source_size", "target")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeats: int = 3, budget: int | None = None,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document its size, its source's size and target, and the words that the mix takes of it."""
    sizes = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                               word_count(F.col(text_col)).alias("size"),
                               F.coalesce(F.md5(F.col(id_col).cast("string")), F.lit("")).alias("draw")))
    shares = targets(sizes, weights, max_repeats, budget)
    sizes = sizes.withColumn("slice", F.substring("draw", 1, 3))
    slices = sizes.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)))
    share_of = shares.select(F.col("source").alias("s"), "source_size", "target")
    slices = slices.join(share_of, slices["source"].eqNullSafe(F.col("s"))).drop("s")
    inside = (Window.partitionBy("source", "slice").orderBy("draw", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = sizes.withColumn("within", F.sum("size").over(inside))
    head = slices.select(F.col("source").alias("s"), F.col("slice").alias("k"), "before", "source_size", "target")
    placed = stored(placed.join(head, placed["source"].eqNullSafe(F.col("s")) & (placed["slice"] == F.col("k")), "left")
                    .select("doc_id", "source", "size", "source_size", "target", "draw",
                            (F.col("before") + F.col("within")).alias("cumulative")))

    def finish(copy: Column | int) -> Column:
        return F.try_divide((F.col("cumulative") + F.col("source_size") * copy).cast("double"), F.col("target"))

    copies = (placed.filter(F.col("size") > 0)
              .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
              .withColumn("finish", finish(F.col("copy")))
              .withColumn("step", F.floor(F.least(F.col("finish"), F.lit(float(HORIZON))) * STEPS)))
    total = budget if budget is not None else placed.agg(F.sum("size")).first()[0] or 0
    # At most STEPS * HORIZON + 1 rows, whatever the input.
    histogram = sorted(copies.filter(F.col("step").isNotNull()).groupBy("step").agg(F.sum("size").alias("n")).collect())
    taken, cut = 0, None
    for step, n in histogram:
        if taken + n > total:
            cut = step
            break
        taken += n
    counted: Column = F.lit(max_repeats)
    if cut is not None:
        queue = (Window.partitionBy("step").orderBy("finish", "draw", "doc_id", "copy")
                 .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        fits = (copies.filter(F.col("step") == cut).withColumn("queued", F.sum("size").over(queue))
                .filter(F.col("queued") <= total - taken))
        last = fits.agg(F.max(F.struct("finish", "draw", "doc_id", "copy")).alias("last")).first()["last"]
        if last is None:
            inside_cut = [F.floor(F.least(finish(e), F.lit(float(HORIZON))) * STEPS) < cut for e in range(max_repeats)]
        else:
            kinds = {name: copies.schema[name].dataType for name in ("finish", "draw", "doc_id", "copy")}
            end = F.struct(*[F.lit(last[name]).cast(kind).alias(name) for name, kind in kinds.items()])
            inside_cut = [F.struct(finish(e).alias("finish"), "draw", "doc_id", F.lit(e).alias("copy")) <= end
                          for e in range(max_repeats)]
        counted = sum((F.when(x, 1).otherwise(0) for x in inside_cut), F.lit(0))
    return placed.select("doc_id", "source", "size", "source_size", F.col("target").cast("double"),
                         F.coalesce(F.col("size") * counted, F.lit(0)).cast("long").alias("taken"))


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(CAST(doc_id AS VARCHAR)) AS draw FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT source, source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM sums),
steps AS (
  SELECT *, (SELECT sum(source_size) FROM sums) - 3 * coalesce(sum(source_size) OVER o, 0) AS rest,
         sum(weight) OVER (ORDER BY 3.0 * source_size / weight DESC, source DESC NULLS FIRST
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open_weight
  FROM ranked WINDOW o AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT max(rest::DOUBLE / open_weight::DOUBLE) AS unit FROM steps),
shares AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, weight * unit) AS target FROM ranked, level),
placed AS (
  SELECT d.doc_id, d.source, d.size, d.draw, s.source_size, s.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS cumulative
  FROM sized d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source),
copies AS (
  SELECT *, (cumulative + source_size * copy)::DOUBLE / target AS finish
  FROM placed, (SELECT unnest([0, 1, 2]) AS copy) WHERE size > 0),
queued AS (SELECT *, sum(size) OVER (ORDER BY finish, draw, doc_id, copy ROWS UNBOUNDED PRECEDING) AS queue FROM copies),
counts AS (SELECT doc_id, draw, count(*) AS n FROM queued WHERE queue <= (SELECT sum(size) FROM sized) GROUP BY ALL)
SELECT p.doc_id, p.size::BIGINT AS size, p.source_size, p.target, (p.size * coalesce(c.n, 0))::BIGINT AS taken
FROM placed p LEFT JOIN counts c ON p.doc_id = c.doc_id
"""
