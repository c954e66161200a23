"""Schemas of records and of the wide event rows that sinks write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A record of a block file, with its place.
RECORD = "record_type string, seq long, ts_unix_ns long, payload binary, block_offset long, position int"

#: The columns of an event row, in order.
WIDE = """sequence long, timestamp_unix_ns long, signal_type string, observed_timestamp_unix_ns long, trace_id string, span_id string,
trace_flags long, severity_number int, severity_text string, body_kind string, body_string string, body_json string,
metric_name string, metric_description string, metric_unit string, metric_type string, metric_value_number double,
metric_value_count long, metric_value_sum double, is_monotonic boolean, aggregation_temporality int, span_name string,
span_kind string, parent_span_id string, start_time_unix_ns long, end_time_unix_ns long, duration_ns long, status_code int,
status_message string, service_name string, scope_name string, scope_version string, resource_attributes_json string,
scope_attributes_json string, log_attributes_json string, span_attributes_json string, event_name string"""


def wide(df: DataFrame) -> DataFrame:
    """The event columns in order, null where ``df`` lacks one; zero and empty values are unset but for the first three columns."""
    out = []
    for i, column in enumerate(WIDE.replace("\n", " ").split(", ")):
        name, kind = column.split()
        value = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        if i > 2 and name in df.columns and kind in ("string", "long", "int"):
            value = F.nullif(value, F.lit("" if kind == "string" else 0).cast(kind))
        out.append(value.alias(name))
    return df.select(*out)
