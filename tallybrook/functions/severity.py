"""Severity and kind names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names of the six classes of four severity numbers each, from 1 on.
CLASSES = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
#: Span kinds from 1 on.
SPAN_KINDS = ("Internal", "Server", "Client", "Producer", "Consumer")


def label(number: Column) -> Column:
    """Name of a severity number from 1 to 24, else null."""
    return F.when(number.between(1, 24), F.element_at(F.array(*map(F.lit, CLASSES)), F.floor((number - 1) / 4).cast("int") + 1))


def label_clamped(number: Column) -> Column:
    """Name of any severity number: low ones count as TRACE, high ones as FATAL."""
    return label(F.greatest(F.lit(1), F.least(F.lit(24), number)))


def severity_class(number: Column) -> Column:
    """0 (unset) to 6 (FATAL)."""
    return F.when(number.between(1, 24), F.floor((number - 1) / 4).cast("int") + 1).otherwise(0)


def span_kind(number: Column) -> Column:
    name = F.when(number.between(1, 5), F.element_at(F.array(*map(F.lit, SPAN_KINDS)), number.cast("int")))
    return F.coalesce(name, F.concat(F.lit("Unknown("), number.cast("string"), F.lit(")")))
