"""Record and event predicates: each takes a DataFrame and returns the rows that match, or is a column condition.

Conditions replace a textual expression language: they are written with column functions, and ``holds`` gives them its rule that
a condition over an unset value doesn't match.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def record_type(kind: str, column: str = "record_type") -> Column:
    return F.col(column) == kind


def between(column: str, low: int | None = None, high: int | None = None) -> Column:
    """Inclusive range of sequence numbers or nanoseconds; a missing bound is open."""
    out = F.lit(True)
    if low is not None:
        out &= F.col(column) >= low
    if high is not None:
        out &= F.col(column) <= high
    return out


def literals(column: str, words: Iterable[str], ignore_case: bool = False) -> Column:
    """All words occur."""
    out = F.lit(True)
    text = F.lower(F.col(column)) if ignore_case else F.col(column)
    for w in words:
        out &= F.contains(text, F.lit(w.lower() if ignore_case else w))
    return out


def patterns(column: str, regexes: Iterable[str], ignore_case: bool = False) -> Column:
    """All regular expressions are found."""
    out = F.lit(True)
    for r in regexes:
        out &= F.col(column).rlike(("(?i)" if ignore_case else "") + r)
    return out


def holds(condition: Column) -> Column:
    """False where the condition is unset."""
    return F.coalesce(condition, F.lit(False))


def nonempty(values: Iterable[str], what: str) -> list[str]:
    out = list(values)
    if not out or any(not v for v in out):
        raise ValueError(f"{what} must not be empty")
    return out


def in_sets(services: Iterable[str] = (), severities: Iterable[str] = ()) -> Column:
    """Event grain: a service set asks for a service that is in it."""
    out = F.lit(True)
    if services := list(services):
        out &= holds(F.col("service_name").isin(nonempty(services, "service")))
    if severities := list(severities):
        out &= holds(F.col("severity_text").isin(nonempty(severities, "severity")))
    return out


def any_of_batch(df: DataFrame, batch: str, condition: Column) -> DataFrame:
    """Batches with an event for which the condition holds: (batch, events, matching)."""
    hit = holds(condition)
    return df.groupBy(batch).agg(F.count(F.lit(1)).alias("events"), F.count_if(hit).alias("matching")).filter("matching > 0")


def no_offender(df: DataFrame, batch: str, services: Iterable[str] = (), severities: Iterable[str] = ()) -> DataFrame:
    """Events of batches in which no event names another service or severity; unset names don't offend."""
    bad = F.lit(False)
    if services := list(services):
        bad |= holds(~F.col("service_name").isin(nonempty(services, "service")))
    if severities := list(severities):
        bad |= holds(~F.col("severity_text").isin(nonempty(severities, "severity")))
    return df.join(df.filter(bad).select(batch).distinct(), batch, "left_anti")
