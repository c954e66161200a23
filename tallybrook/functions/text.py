"""Rendering of values as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def preview(text: Column, limit: int) -> Column:
    """At most ``limit`` UTF-8 bytes, whole characters only, with '...' where something is cut; '' for limit 0."""
    if limit == 0:
        return F.when(text.isNotNull(), F.lit(""))
    # 3 of 4 bytes at the end may belong to a character that is cut
    raw = F.substring(text.cast("binary"), 1, limit)
    head = F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "�+$", "")
    return F.when(F.octet_length(text) > limit, F.concat(head, F.lit("..."))).otherwise(text)


def single_line(text: Column, limit: int = 160) -> Column:
    """Control characters as spaces, the first ``limit`` characters, '...' where something is cut."""
    flat = F.regexp_replace(text, r"[\x00-\x1f\x7f]", " ")
    return F.when(F.char_length(flat) > limit, F.concat(F.left(flat, F.lit(limit)), F.lit("..."))).otherwise(flat)


def hex_preview(raw: Column, limit: int = 32) -> Column:
    return F.lower(F.hex(F.substring(raw, 1, limit)))


def ns_time(ns: Column) -> Column:
    """Whole seconds of nanoseconds since 1970, as a time without zone."""
    seconds = F.floor(ns / F.lit(10**9).cast("decimal(20,0)")).cast("long")
    return F.timestamp_add("SECOND", seconds, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def ns_text(ns: Column) -> Column:
    """Nanoseconds since 1970 as 'YYYY-MM-DD HH:MM:SS.nnnnnnnnn UTC'."""
    seconds = F.date_format(ns_time(ns), "yyyy-MM-dd HH:mm:ss")
    return F.concat(seconds, F.lit("."), F.lpad(F.pmod(ns, F.lit(10**9)).cast("string"), 9, "0"), F.lit(" UTC"))


def syslog_time(ns: Column) -> Column:
    """Nanoseconds as 'Mon dd HH:MM:SS', the day padded with a space."""
    at = ns_time(ns)
    return F.concat(F.date_format(at, "MMM"), F.lit(" "), F.lpad(F.dayofmonth(at).cast("string"), 2, " "), F.lit(" "), F.date_format(at, "HH:mm:ss"))


def human_size(text: Column) -> Column:
    """Bytes of '5mb' (powers of 1000), '5mib' (powers of 1024), or '5' (KiB); null for others."""
    number = F.try_to_number(F.regexp_extract(text, r"^\s*(\d+)", 1), F.lit("999999999999")).cast("long")
    unit = F.lower(F.regexp_extract(text, r"^\s*\d+\s*([A-Za-z]*)\s*$", 1))
    scale = F.create_map(*[F.lit(x) for k, v in {"": 1024, "b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "kib": 1 << 10, "mib": 1 << 20, "gib": 1 << 30}.items() for x in (k, v)])
    return F.when(text.rlike(r"^\s*\d+\s*[A-Za-z]*\s*$"), number * F.try_element_at(scale, unit))


def any_text(kind: Column, text: Column, size: Column) -> Column:
    """Display text of a tagged value: arrays, maps and bytes as their size."""
    return (
        F.when(kind == "array", F.concat(F.lit("<array:"), size.cast("string"), F.lit(">")))
        .when(kind == "map", F.concat(F.lit("<map:"), size.cast("string"), F.lit(">")))
        .when(kind == "bytes", F.concat(F.lit("<"), size.cast("string"), F.lit(" bytes>")))
        .otherwise(F.coalesce(text, F.lit("null")))
    )
