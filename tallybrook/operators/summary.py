"""Counts and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.functions.severity import severity_class

#: Values that a bounded distinct keeps.
DISTINCT_LIMIT = 16


def file_summary(df: DataFrame, condition: Column, file: str = "file", ts: str = "ts_ns") -> DataFrame:
    """Per file: records scanned and matched, first and last time of matches; files without matches have zeros and nulls."""
    return df.groupBy(file).agg(
        F.count(F.lit(1)).alias("records_scanned"),
        F.count_if(condition).alias("records_matched"),
        F.min(F.when(condition, F.col(ts))).alias("first_ts"),
        F.max(F.when(condition, F.col(ts))).alias("last_ts"),
    )


def count_by(df: DataFrame, column: str, unset: str | None = None) -> DataFrame:
    """(value, n); unset values are skipped, or counted under the name ``unset``."""
    value = F.nullif(F.col(column), F.lit(""))
    rows = df.select(F.coalesce(value, F.lit(unset)).alias("value") if unset else value.alias("value"))
    return rows.filter("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def top(counts: DataFrame, k: int) -> DataFrame:
    """The k largest counts, ties by value."""
    return counts.orderBy(F.col("n").desc(), "value").limit(k)


def catalogue(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct values of each column as (kind, value)."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(each.alias("x")).select("x.*").filter("value is not null").distinct()


def bounded_distinct(df: DataFrame, group: str, column: str, limit: int = DISTINCT_LIMIT) -> DataFrame:
    """(group, n, complete, values): values only where there are no more than ``limit``."""
    values = df.select(group, column).filter(F.col(column).isNotNull()).distinct()
    sizes = values.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    lists = values.join(sizes.filter(F.col("n") <= limit).select(group), group).groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(F.col(column).cast("string"))), ",").alias("values"))
    return sizes.join(lists, group, "left").withColumn("complete", F.col("n") <= limit)


def first_last(df: DataFrame, group: str, position: str, *columns: str) -> DataFrame:
    """Values at the first and last position of each group."""
    return df.groupBy(group).agg(*[f(c, position).alias(f"{p}_{c}") for c in columns for f, p in ((F.min_by, "first"), (F.max_by, "last"))])


def type_mask(df: DataFrame, group: str, column: str) -> DataFrame:
    """Bits of the record types in a group: logs 1, metrics 2, traces 4, events 8."""
    bit = F.when(F.col(column) == "logs", 1).when(F.col(column) == "metrics", 2).when(F.col(column) == "traces", 4).when(F.col(column) == "events", 8).otherwise(0)
    return df.groupBy(group).agg(F.bit_or(bit).alias("mask"))


def batch_priority(df: DataFrame, batch: str, number: str = "severity_number") -> DataFrame:
    """The highest severity class of each batch."""
    return df.groupBy(batch).agg(F.max(severity_class(F.col(number))).alias("priority"))


def field_stats(df: DataFrame, group: str, size: Column, ts: str) -> DataFrame:
    """Records, bytes, time range and size summary per group."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(size).cast("long").alias("bytes"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.min(size).cast("long").alias("min_bytes"),
        F.max(size).cast("long").alias("max_bytes"),
        F.round(F.avg(size), 6).alias("avg_bytes"),
    )


def regrouped(df: DataFrame, position: str, *keys: str) -> DataFrame:
    """Groups by resource and scope, numbered by first appearance; members keep their order by (group, position)."""
    groups = df.groupBy(*keys).agg(F.min(position).alias("first_pos"), F.max(position).alias("last_pos"), F.count(F.lit(1)).alias("members"))
    return groups
