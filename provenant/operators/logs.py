"""Query-log analytics: metrics, threads, feedback, anchored windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from provenant.functions import policy

RECENT_LIMIT = 200
RECENT_CHARS = 200


def trailing(rows: DataFrame, now: Column, hours: int = 24, at: str = "created_at") -> DataFrame:
    return rows.filter(F.col(at) >= now - F.expr(f"interval {hours} hours"))


METRIC_COUNTS = {
    "declined_count": "declined", "high_count": "confidence_tier = 'HIGH'",
    "medium_count": "confidence_tier = 'MEDIUM'", "low_count": "confidence_tier = 'LOW'",
    "cached_count": "cached", "degraded_count": "degraded"}


def metric_aggregates(p95: Column | None = None) -> list[Column]:
    return [F.count(F.lit(1)).alias("total"),
            *[F.count_if(F.expr(c)).alias(name) for name, c in METRIC_COUNTS.items()],
            *([] if p95 is None else [p95.alias("p95_latency_ms")]),
            F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("double").alias("daily_spend_usd")]


def with_rates(rows: DataFrame) -> DataFrame:
    rate = lambda c: F.coalesce(F.try_divide(c, "total"), F.lit(0.0))
    return rows.withColumns({"decline_rate": rate("declined_count"), "cache_hit_rate": rate("cached_count"),
                             "degraded_rate": rate("degraded_count")})


def percentile(rows: DataFrame, value: str, share: float, by: Sequence[str] = (), ranges: int = 1024, passes: int = 2) -> DataFrame:
    """Exact percentile per group, interpolated between two neighbours, as ``percentile``; by selection instead of one state of all values.

    Each pass counts a group's values in ``ranges`` equal parts of the interval that still holds the wanted ranks, and goes on with the part or two
    that do. The last one counts the distinct values left. All counts are added up in the map tasks first, so no task holds a group.
    Nulls do not count; a group of nothing else has no row.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    x = rows.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value).cast("double").alias("_x")).filter("_x is not null")
    place = (F.col("_n") - 1) * share
    first, last = F.floor(place), F.ceil(place)
    # Per group: rows, and of the interval its ends and how many values lie below it.
    state = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")).withColumn("_below", F.lit(0).cast("long")).filter("_n > 0")

    def inside(state: DataFrame) -> DataFrame:
        named = state.select(*[F.col(k).alias(f"s{k}") for k in keys], "_n", "_lo", "_hi", "_below")
        same = [F.col(k).eqNullSafe(F.col(f"s{k}")) for k in keys]
        # Without groups the state is one row.
        met = x.join(named, same) if keys else x.join(F.broadcast(named), F.col("_x").between(F.col("_lo"), F.col("_hi")))
        return met.filter(F.col("_x").between(F.col("_lo"), F.col("_hi"))).select(*keys, "_x", "_n", "_lo", "_hi", "_below")

    def with_rank(parts: DataFrame, order: str) -> DataFrame:
        """Parts that hold a wanted rank, with the number of values before each."""
        earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        ranked = parts.withColumn("_before", F.col("_below") + F.coalesce(F.sum("_c").over(earlier), F.lit(0)))
        return ranked.filter((F.col("_before") <= last) & (F.col("_before") + F.col("_c") > first))

    for _ in range(passes):
        part = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * ranges), F.lit(ranges - 1))).otherwise(0)
        parts = inside(state).groupBy(*keys, "_n", "_below", part.alias("_part")).agg(F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        state = with_rank(parts, "_part").groupBy(*keys, "_n").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.min("_before").alias("_below"))
    values = with_rank(inside(state).groupBy(*keys, "_n", "_below", "_x").agg(F.count(F.lit(1)).alias("_c")), "_x")
    ends = values.groupBy(*keys, "_n").agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    return ends.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (place - first)).alias("percentile"))


def metrics(log: DataFrame, now: Column, hours: int = 24, by: Sequence[str] = (), accuracy: int | None = None) -> DataFrame:
    """Counts, exact p95 latency, spend and rates over the trailing window; zero rates if empty.

    ``accuracy`` swaps the exact percentile, which reads the log three times more, for a sketch of bounded size.
    """
    rows = trailing(log, now, hours)
    if accuracy is not None:
        return with_rates(rows.groupBy(*by).agg(*metric_aggregates(F.percentile_approx("latency_ms", 0.95, accuracy).cast("double"))))
    counted = rows.groupBy(*by).agg(*metric_aggregates())
    p95 = percentile(rows, "latency_ms", 0.95, by).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("percentile").alias("p95_latency_ms"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] or F.lit(True)
    joined = counted.join(F.broadcast(p95) if not by else p95, same, "left").drop(*[f"_{c}" for c in by])
    return with_rates(joined.select(*by, "total", *METRIC_COUNTS, "p95_latency_ms", "daily_spend_usd"))


def feedback_count(feedback: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    return trailing(feedback, now, hours).agg(F.count(F.lit(1)).alias("feedback_count"))


def recent_queries(log: DataFrame, n: int = 50) -> DataFrame:
    """Newest queries, at most 200, texts cut for display. The sort keeps n rows per task."""
    columns = ["id", "query_text", "detected_language", "declined", "confidence_tier", "cached", "degraded",
               "latency_ms", "created_at"]
    newest = log.orderBy(F.desc("created_at"), F.desc("id")).limit(min(n, RECENT_LIMIT))
    return newest.withColumn("query_text", F.substring("query_text", 1, RECENT_CHARS)).select(*columns)


def query_total(log: DataFrame) -> DataFrame:
    return log.agg(F.count(F.lit(1)).alias("total"))


def _threads(log: DataFrame) -> DataFrame:
    return log.filter(F.col("correlation_id").isNotNull() & (F.col("correlation_id") != ""))


def thread_summaries(log: DataFrame) -> DataFrame:
    """First question, size, last activity and last language per thread."""
    moment = F.struct("created_at", "id")
    return _threads(log).groupBy(F.col("correlation_id").alias("thread_id")).agg(
        F.min_by("query_text", moment).alias("first_question"), F.count(F.lit(1)).alias("message_count"),
        F.max("created_at").alias("last_activity"), F.max_by("detected_language", moment).alias("detected_language"))


def threads(log: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of thread summaries, most recent first."""
    return thread_summaries(log).orderBy(F.desc("last_activity"), "thread_id").offset(offset).limit(limit)


def thread_count(log: DataFrame, approx: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approx else F.count_distinct
    return _threads(log).agg(count("correlation_id").alias("total"))


def thread_messages(log: DataFrame, feedback: DataFrame, thread_id: str | None = None, latest_only: bool = False) -> DataFrame:
    """Messages oldest first with their rating; several ratings repeat the message.

    Without ``thread_id`` all threads are listed; ``latest_only`` keeps one rating each.
    """
    rated = feedback.select(F.col("query_id").alias("id"), F.col("rating").alias("feedback_rating"), F.col("created_at").alias("_rated"))
    if latest_only:
        rated = rated.groupBy("id").agg(F.max_by("feedback_rating", F.struct("_rated", "feedback_rating")).alias("feedback_rating"))
    mine = _threads(log) if thread_id is None else log.filter(F.col("correlation_id") == thread_id)
    return mine.join(rated.drop("_rated"), "id", "left").orderBy("correlation_id", "created_at", "id")


def feedback_report(feedback: DataFrame, log: DataFrame, ratings: Sequence[str] = ("not_helpful", "out_of_scope"),
                    n: int = 20) -> DataFrame:
    """Newest feedback of the given ratings with its question and a preview of the answer.

    Feedback is sorted and cut per task before the texts of n queries are joined.
    """
    known = feedback.filter(F.col("rating").isin(*ratings)).join(log.select(F.col("id").alias("query_id")), "query_id", "left_semi")
    newest = known.orderBy(F.desc("created_at"), F.desc("id")).limit(n)
    texts = log.select(F.col("id").alias("query_id"), "detected_language", "declined", "degraded", "query_text", "response_text")
    rows = newest.join(texts, "query_id")
    return rows.select("id", "query_id", "rating", "created_at", "detected_language", "declined", "degraded", "query_text",
                       policy.preview(F.col("response_text")).alias("preview"), "comment").orderBy(F.desc("created_at"), F.desc("id"))


def rating_patterns(feedback: DataFrame, log: DataFrame) -> DataFrame:
    """Ratings per act; a query over no act counts under a null act."""
    acts = log.select(F.col("id").alias("query_id"), F.explode_outer("act_ids").alias("act_id"))
    return feedback.join(acts, "query_id").groupBy("act_id", "rating").agg(F.count(F.lit(1)).alias("n"))
