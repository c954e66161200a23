"""Overload, ring buffer and retention rules in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.operators import ranges


def rate_limited(df: DataFrame, stream: str, second: Column, order: list[str], limit: int, priority: Column, floor: int) -> DataFrame:
    """Adds ``decision``: accepted for a stream's first ``limit`` batches of a second (0: all), bypass from priority ``floor`` on, else rejected.

    Windows here are whole seconds; the streaming form starts a window with the first batch after the last one has ended.
    """
    if limit == 0:
        return df.withColumn("decision", F.lit("accepted"))
    n = F.row_number().over(Window.partitionBy(stream, "__second").orderBy(*order))
    out = df.withColumn("__second", second).withColumn("__n", n)
    return out.withColumn("decision", F.when(F.col("__n") <= limit, "accepted").when(priority >= floor, "bypass").otherwise("rejected")).drop("__second", "__n")


def oversize(df: DataFrame, size: Column, limit: int) -> DataFrame:
    """Adds ``oversize``."""
    return df.withColumn("oversize", size > limit)


def ring(df: DataFrame, stream: str, seq: str, keep_first: int, keep_last: int) -> DataFrame:
    """Rows that a stream's ring buffer holds at its end: the first ``keep_first`` for ever, and the newest ``keep_last`` of the others."""
    rows = ranges.running(ranges.ranged(df, seq), [stream], [seq], F.lit(1), "__a")
    rows = ranges.running(rows, [stream], [seq], F.lit(1), "__z", falling=True)
    return rows.filter((F.col("__a") <= keep_first) | (F.col("__z") <= keep_last)).drop("__a", "__z", "__range")


def ring_by_bytes(df: DataFrame, stream: str, seq: str, size: Column, keep_first: int, limit: int) -> DataFrame:
    """The same with a byte limit: the oldest unprotected rows go until all held rows fit."""
    rows = ranges.running(ranges.ranged(df, seq).withColumn("__s", size), [stream], [seq], F.lit(1), "__a")
    first = F.col("__a") <= keep_first
    heads = rows.filter(first).groupBy(F.col(stream).alias("__stream")).agg(F.sum("__s").alias("__head"))  # a row per stream
    rows = ranges.running(rows, [stream], [seq], F.when(~first, F.col("__s")).otherwise(0), "__newer", falling=True)
    rows = rows.join(heads, F.col(stream).eqNullSafe(F.col("__stream")), "left")
    held = F.coalesce("__head", F.lit(0)) + F.col("__newer") <= limit
    return rows.filter(first | held).drop("__s", "__a", "__head", "__newer", "__stream", "__range")


def retained(segments: DataFrame, stream: str, segment: str, size: str, limit: int) -> DataFrame:
    """Adds ``kept``: the oldest segments go until the rest fits in ``limit`` bytes; the newest stays."""
    newest = Window.partitionBy(stream).orderBy(F.col(segment).desc())
    upto = F.sum(size).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return segments.withColumn("kept", (upto <= limit) | (F.row_number().over(newest) == 1))


def keep_bytes(segments: DataFrame, stream: str, segment: str, size: str, limit: int) -> DataFrame:
    """Adds ``kept``: segments from the newest on while the bytes before them are under ``limit``; the crossing one stays."""
    before = Window.partitionBy(stream).orderBy(F.col(segment).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("kept", F.coalesce(F.sum(size).over(before), F.lit(0)) < limit)


def keep_files(segments: DataFrame, stream: str, segment: str, n: int) -> DataFrame:
    """Adds ``kept``: the newest ``n`` segments, one at least."""
    return segments.withColumn("kept", F.row_number().over(Window.partitionBy(stream).orderBy(F.col(segment).desc())) <= max(1, n))


def rotated(df: DataFrame, stream: str, order: list[str], size: Column, limit: int) -> DataFrame:
    """Adds ``segment``: a new one begins where the bytes written cross a multiple of ``limit``."""
    return ranges.running(df, [stream], order, size, "segment", own=False).withColumn("segment", F.floor(F.col("segment") / limit).cast("long"))
