"""Orders over several inputs, paging, splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.operators import ranges


def merge_key(df: DataFrame, file: str, position: str, *keys: str) -> DataFrame:
    """Adds the merge order's key: the greatest (keys) so far within the file. For sorted files it is the row's own."""
    return ranges.running(df, [file], [position], F.struct(*keys), "merge_key", "max")


def merged(df: DataFrame, file: str, position: str, *keys: str) -> DataFrame:
    """Rows in the order in which a merge of the files by ``keys`` gives them."""
    return merge_key(df, file, position, *keys).orderBy("merge_key", file, position)


def page(df: DataFrame, by: str, offset: int, limit: int) -> DataFrame:
    """A page of the list and the next page's offset, null on the last."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    total = df.agg(F.count(F.lit(1)).alias("__total"))
    rows = df.orderBy(by).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row
    return rows.withColumn("next_offset", F.when(F.col("__total") > offset + limit, F.lit(offset + limit))).drop("__total")


def numbered(df: DataFrame, by: list[str], within: str | None = None, out: str = "row_no") -> DataFrame:
    """Gapless row numbers from 1, in all or within a stream, from counts per range of the first key."""
    return ranges.running(df, [within] if within else [], by, F.lit(1), out)


def row_range(df: DataFrame, by: list[str], first: int, last: int) -> DataFrame:
    """Rows ``first`` to ``last`` (from 1, inclusive) of the order."""
    return numbered(df, by).filter(F.col("row_no").between(first, last))


def split_by_records(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """Adds ``part``: consecutive runs of ``n`` rows."""
    return numbered(df, by).withColumn("part", F.floor((F.col("row_no") - 1) / n).cast("long"))


def split_by_bytes(df: DataFrame, by: list[str], size: Column, n: int, within: str) -> DataFrame:
    """Adds ``part``: rows of one stream cut where the running size crosses a multiple of ``n`` bytes."""
    return ranges.running(df, [within], by, size, "part", own=False).withColumn("part", F.floor(F.col("part") / n).cast("long"))


def continuity(df: DataFrame, stream: str, seq: str) -> DataFrame:
    """Gaps of a stream's sequence: (stream, after, before, missing)."""
    rows = ranges.previous(df, [stream], [seq], [seq], "after").withColumn("after", F.col("after")[seq])
    gaps = rows.filter(F.col(seq) - F.col("after") > 1)
    return gaps.select(stream, "after", F.col(seq).alias("before"), (F.col(seq) - F.col("after") - 1).alias("missing"))
