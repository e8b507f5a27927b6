"""Trailing query-log metrics as sliding windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from provenant.operators.logs import metric_aggregates, with_rates


def stream_metrics(log: DataFrame, length: str = "24 hours", slide: str = "1 hour", late: str = "1 hour",
                   accuracy: int = 10_000) -> DataFrame:
    """Counts, approximate p95 latency, spend and rates per window; rows behind the watermark
    are dropped. The percentile is a sketch, so state per window is bounded."""
    p95 = F.percentile_approx("latency_ms", 0.95, accuracy).cast("double")
    windows = log.withWatermark("created_at", late).groupBy(F.window("created_at", length, slide)).agg(
        *metric_aggregates(p95))
    return with_rates(windows.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                                     *[c for c in windows.columns if c != "window"]))
