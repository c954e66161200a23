"""Conditions over event rows: each signal's variables as columns, checked before anything is read.

A condition is a function from a signal's variables to a Boolean column::

    conditions.matching(events, "logs", lambda v: (v.severity_number >= 13) & (v.attributes["user"] == "7"))

A variable that an event doesn't set is null, and a condition over it doesn't match. A name that the signal lacks, or a result that
isn't Boolean, is an error at once.
"""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybrook.functions.severity import SPAN_KINDS
from tallybrook.operators.predicates import holds


def _map(column: str) -> Column:
    """A JSON object of attributes as a map of texts; empty where there is none."""
    return F.coalesce(F.from_json(column, "map<string,string>"), F.expr("map()").cast("map<string,string>"))


def _positive(column: str) -> Column:
    return F.when(F.col(column) > 0, F.col(column))


def _or(column: str, default: object) -> Column:
    return F.coalesce(F.col(column), F.lit(default))


def _common() -> dict[str, Column]:
    return {"service_name": F.col("service_name"), "scope_name": F.col("scope_name"), "resource": _map("resource_attributes_json"), "scope": _map("scope_attributes_json")}


def _logs() -> dict[str, Column]:
    return {
        "body": F.coalesce("body_string", "body_json", F.lit("")),
        "severity_text": _or("severity_text", ""),
        "severity_number": _or("severity_number", 0),
        "event_name": F.col("event_name"),
        "time_unix_nano": _or("timestamp_unix_ns", 0),
        "observed_time_unix_nano": _positive("observed_timestamp_unix_ns"),
        "trace_id": F.col("trace_id"),
        "span_id": F.col("span_id"),
        "flags": _positive("trace_flags"),
        "attributes": _map("log_attributes_json"),
        **_common(),
    }


def _metrics() -> dict[str, Column]:
    return {
        "metric_name": _or("metric_name", ""),
        "metric_unit": F.col("metric_unit"),
        "metric_description": F.col("metric_description"),
        "metric_type": _or("metric_type", ""),
        "value": _or("metric_value_number", 0.0),
        "count": _or("metric_value_count", 0),
        "sum": _or("metric_value_sum", 0.0),
        "time_unix_nano": _positive("timestamp_unix_ns"),
        "attributes": _map("log_attributes_json"),
        **_common(),
    }


def _traces() -> dict[str, Column]:
    numbers = F.create_map(*[F.lit(x) for i, k in enumerate(SPAN_KINDS, 1) for x in (k, i)])
    return {
        "trace_id": F.col("trace_id"),
        "span_id": _or("span_id", ""),
        "parent_span_id": F.col("parent_span_id"),
        "name": _or("span_name", ""),
        "kind": F.coalesce(F.try_element_at(numbers, F.col("span_kind")), F.lit(0)),
        "start_time_unix_nano": _positive("start_time_unix_ns"),
        "end_time_unix_nano": _positive("end_time_unix_ns"),
        "duration_ns": _positive("duration_ns"),
        "status_code": _or("status_code", 0),
        "status_message": F.col("status_message"),
        "attributes": _map("span_attributes_json"),
        **_common(),
    }


SIGNALS = {"logs": _logs, "metrics": _metrics, "traces": _traces}


def variables(signal: str) -> SimpleNamespace:
    """The columns that a condition over ``signal`` ('logs', 'metrics' or 'traces') can use, over the wide event columns."""
    if signal not in SIGNALS:
        raise ValueError(f"no such signal: {signal}")
    return SimpleNamespace(**SIGNALS[signal]())


def matching(events: DataFrame, signal: str, condition: Callable[[SimpleNamespace], Column]) -> DataFrame:
    """The events of ``signal`` for which the condition holds. Raises ValueError for unknown variables and other than Boolean results."""
    try:
        test = condition(variables(signal))
    except AttributeError as e:
        raise ValueError(f"no such variable: {e.name}") from e
    kind = events.select(test.alias("x")).schema["x"].dataType if isinstance(test, Column) else None
    if not isinstance(kind, T.BooleanType):
        raise ValueError("a condition must be Boolean")
    return events.filter((F.col("signal_type") == signal) & holds(test))
