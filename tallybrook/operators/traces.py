"""Span trees and latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_parent(spans: DataFrame, trace: str = "trace_id", span: str = "span_id", parent: str = "parent_span_id") -> DataFrame:
    """Spans with their parent's name and start, null for roots and for spans whose parent is missing."""
    parents = spans.select(F.col(trace).alias("__t"), F.col(span).alias("__s"), F.col("name").alias("parent_name"), F.col("start_ns").alias("parent_start_ns"))
    return spans.join(parents, (F.col(trace) == F.col("__t")) & (F.col(parent) == F.col("__s")), "left").drop("__t", "__s")


def latencies(spans: DataFrame, group: str) -> DataFrame:
    """Count, least, greatest, mean and percentiles of durations (never negative)."""
    d = F.greatest(F.col("end_ns") - F.col("start_ns"), F.lit(0))
    out = spans.withColumn("__d", d).groupBy(group)
    quantile = lambda p: F.round(F.percentile("__d", p), 3)
    return out.agg(F.count(F.lit(1)).alias("spans"), F.min("__d").alias("min_ns"), F.max("__d").alias("max_ns"), F.round(F.avg("__d"), 3).alias("mean_ns"), quantile(0.5).alias("p50_ns"), quantile(0.95).alias("p95_ns"), quantile(0.99).alias("p99_ns"))
