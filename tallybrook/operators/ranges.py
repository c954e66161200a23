"""Windows over an order that don't need one task for each stream: what comes before a row is told per range of positions first.

Positions are cut into ranges of equal depth; a stream's rows of one range are a window of their own, and each range gets what the ranges before
it leave behind (a last row, a sum, a maximum) from a small table with a row per stream and range. So a single stream with all rows is
spread over as many tasks as there are ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows a range aims at, and the most ranges.
RANGE_ROWS, RANGES = 1 << 16, 512
#: Values of other than numeric positions that cut points are taken from.
SAMPLE = 20_000


def ranged(df: DataFrame, by: str) -> DataFrame:
    """Adds ``__range``, which never falls as ``by`` rises; equal values share a range, nulls come first. Sparse keys and text are fine."""
    kind = df.schema[by].dataType
    if isinstance(kind, T.NumericType):
        rows, knots = df.agg(F.count(F.lit(1)), _quantiles(by, kind)).first()
        n = min(RANGES, -(-rows // RANGE_ROWS))
        knots = sorted({knots[i * RANGES // n - 1] for i in range(1, n)}) if knots else []
    else:
        rows = df.count()
        n = min(RANGES, -(-rows // RANGE_ROWS))
        some = sorted(r[0] for r in df.select(by).filter(F.col(by).isNotNull()).sample(min(1.0, SAMPLE / rows), 1).limit(2 * SAMPLE).collect()) if n > 1 else []
        knots = sorted({some[i * len(some) // n] for i in range(1, n)}) if some else []
    return _found(df, by, knots)


def _quantiles(by: str, kind: T.DataType) -> Column:
    """Values that cut rows into ``RANGES`` ranges of about equal depth, null without values. A task's sketch of whole numbers is some 50 KB."""
    shares = [i / RANGES for i in range(1, RANGES)]
    if not isinstance(kind, T.IntegralType):
        return F.percentile_approx(by, shares)
    sketch = F.kll_sketch_agg_bigint(by, F.lit(4 * RANGES))
    return F.when(F.count(by) > 0, F.kll_sketch_get_quantile_bigint(sketch, F.array(*map(F.lit, shares))))


def _found(df: DataFrame, by: str, knots: list) -> DataFrame:
    """Adds ``__range``, the number of cut points up to the value, -1 for null. Halving steps over one array: a condition for each cut point is too long to be compiled."""
    points, step = F.array(*map(F.lit, knots)), 1 << len(knots).bit_length()
    out = df.withColumn("__range", F.lit(0))
    while knots and (step := step // 2):
        up = F.col("__range") + step
        out = out.withColumn("__range", F.when(F.try_element_at(points, up) <= F.col(by), up).otherwise(F.col("__range")))
    return out.withColumn("__range", F.when(F.col(by).isNull(), -1).otherwise(F.col("__range")))


def _with(df: DataFrame, facts: DataFrame, stream: Sequence[str]) -> DataFrame:
    """``df`` and the columns of ``facts``, a row per stream and range."""
    keys = [*stream, "__range"]
    facts = facts.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    return df.join(facts, on, "left").drop(*[f"__of_{k}" for k in keys])


def _line(stream: Sequence[str]):
    """Ranges of a stream in order: few rows."""
    return Window.partitionBy(*(stream or [F.lit(0)])).orderBy("__range")


def _after(rows: DataFrame, before: DataFrame, stream: Sequence[str], column: str) -> DataFrame:
    """``rows`` and, ahead of each stream and range (``__first`` is 0 there, 1 in others), a row with what comes before it as ``column``: one shuffle for both."""
    ahead = before.filter("__before is not null").select(*stream, "__range", F.col("__before").cast(rows.schema[column].dataType).alias(column), F.lit(0).alias("__first"))
    return rows.withColumn("__first", F.lit(1)).unionByName(ahead, allowMissingColumns=True)


def previous(df: DataFrame, stream: Sequence[str], order: Sequence[str], columns: Sequence[str], out: str) -> DataFrame:
    """Adds ``out``: ``columns`` of the stream's row before, as a struct; null for the first. The order's columns tell all rows of a stream apart."""
    rows = (df if "__range" in df.columns else ranged(df, order[0])).withColumn("__own", F.struct(*columns))
    last = rows.groupBy(*stream, "__range").agg(F.max_by("__own", F.struct(*order)).alias("__last"))
    last = last.select(*stream, "__range", F.lag("__last").over(_line(stream)).alias("__before"))
    inner = Window.partitionBy(*stream, "__range").orderBy("__first", *order)
    rows = _after(rows, last, stream, "__own").withColumn(out, F.lag("__own").over(inner)).filter("__first = 1").drop("__own", "__first")
    return rows if "__range" in df.columns else rows.drop("__range")


def running(df: DataFrame, stream: Sequence[str], order: Sequence[str], value: Column, out: str, how: str = "sum", own: bool = True, falling: bool = False) -> DataFrame:
    """Adds ``out``: sum or max of ``value`` over the stream's rows up to this one (without it: not ``own``), or from this one on (``falling``)."""
    fold = F.sum if how == "sum" else F.max
    rows = (df if "__range" in df.columns else ranged(df, order[0])).withColumn("__value", value)
    line, sort = _line(stream), [F.col(c) for c in order]
    if falling:
        line, sort = Window.partitionBy(*(stream or [F.lit(0)])).orderBy(F.col("__range").desc()), [F.col(c).desc() for c in order]
    totals = rows.groupBy(*stream, "__range").agg(fold("__value").alias("__total"))
    kind = totals.schema["__total"].dataType
    totals = totals.select(*stream, "__range", fold("__total").over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    rows = _after(rows.withColumn("__value", F.col("__value").cast(kind)), totals, stream, "__value")
    inner = fold("__value").over(Window.partitionBy("__range", *stream).orderBy("__first", *sort).rowsBetween(Window.unboundedPreceding, 0 if own else -1)).cast(kind)
    rows = rows.withColumn(out, F.coalesce(inner, F.lit(0)) if how == "sum" else inner).filter("__first = 1").drop("__value", "__first")
    return rows if "__range" in df.columns else rows.drop("__range")
