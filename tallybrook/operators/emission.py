"""Deduplication of block records end to end: log records out of payloads, groups of them, and payloads again that carry what was found.

Groups are made of narrow rows (place, time, ids, body). A group's other attributes are those of its first record, which are fetched by its place
when payloads are written. What isn't a log request that can be read passes unchanged.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.operators import dedup, ordering, templates
from tallybrook.sources import otlp

#: A log record; ``pos`` is its place in the order of records, ``trace`` and ``span`` are hexadecimal, attributes are encoded entries. Of other records
#: (``passes``) there is the payload alone.
FLAT = """pos struct<seq:long,file:string,block_offset:long,position:int,item:int>, passes boolean, record_type string, ts_unix_ns long, payload binary,
service_name string, severity_number int, severity_text string, scope_name string, event_name string, code_filepath string, code_lineno long,
trace string, span string, time_ns long, observed_ns long, seen_ns long, body string, resource_attributes array<binary>, scope_attributes array<binary>, attributes array<binary>"""
FLAT_NAMES = [c.split()[0] for c in FLAT.replace("\n", " ").split(", ")]

#: Columns of a log record that parts of a selection can be kept apart by.
BUCKETS = {"global": [], "default": ["service_name", "severity_number"], "scope": ["service_name", "severity_number", "scope_name"]}
BUCKETS["source-line"] = [*BUCKETS["default"], "code_filepath", "code_lineno"]
BUCKETS["scope-source-line"] = [*BUCKETS["scope"], "code_filepath", "code_lineno"]

MATCHERS = ("exact", "hash2", "full")


def _entries(raw: list[bytes]) -> dict[str, tuple[str, object]]:
    """(kind, value) by key; the last of equal keys."""
    found = (otlp.fields(e) for e in raw)
    return {otlp.text_of(f, 1): otlp.any_value(f[2][-1]) for f in found if 2 in f}


def _service(raw: list[bytes]) -> str:
    """The first service name, if it is text."""
    for e in raw:
        f = otlp.fields(e)
        if otlp.text_of(f, 1) == "service.name":
            kind, value = otlp.any_value(f[2][-1]) if 2 in f else ("unset", None)
            return value if kind == "string" else ""
    return ""


def _logs(payload: bytes) -> Iterator[tuple]:
    """A request's log records, from ``service_name`` on."""
    for r in otlp.fields(payload).get(1, []):
        rf = otlp.fields(r)
        resource = otlp.fields(rf[1][-1]).get(1, []) if 1 in rf else []
        service = _service(resource)
        for s in rf.get(2, []):
            sf = otlp.fields(s)
            scope = otlp.fields(sf[1][-1]) if 1 in sf else {}
            for item in sf.get(2, []):
                f = otlp.fields(item)
                kind, body = otlp.any_value(f[5][-1]) if 5 in f else ("unset", None)
                own = f.get(6, [])
                code = _entries(own)
                path, line = code.get("code.filepath", ("", None)), code.get("code.lineno", ("", None))
                at, observed = otlp.unsigned(f, 1), otlp.unsigned(f, 11)
                yield (
                    service, otlp.unsigned(f, 2), otlp.text_of(f, 3), otlp.text_of(scope, 1), otlp.text_of(f, 12), path[1] if path[0] == "string" else None, line[1] if line[0] == "int" else None,
                    f.get(9, [b""])[-1].hex(), f.get(10, [b""])[-1].hex(), at, observed, at or observed, body if kind == "string" else "", resource, scope.get(3, []), own,
                )


def unpacked(records: DataFrame) -> DataFrame:
    """Log records (FLAT) of records (file, record_type, seq, ts_unix_ns, payload, block_offset, position), and the records that pass.

    Bodies that aren't text are empty. A log payload that can't be read, or is null, passes whole; a request without log records has no row.
    """
    blank = [None] * (len(FLAT_NAMES) - 5)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for file, kind, seq, ts, payload, offset, position in zip(*(b[c] for c in b.columns), strict=True):
                place = {"seq": seq, "file": file, "block_offset": offset, "position": position}
                try:
                    found = list(_logs(bytes(payload))) if kind == "logs" else None
                except (ValueError, IndexError, struct.error, AttributeError, TypeError):
                    found = None
                if found is None:
                    out.append((place | {"item": 0}, True, kind, ts, payload, *blank))
                else:
                    out += [(place | {"item": i}, False, kind, ts, None, *f) for i, f in enumerate(found)]
            # one column at a time, so that whole numbers with nulls stay whole
            yield pd.DataFrame({c: pd.Series([r[i] for r in out], dtype=object) for i, c in enumerate(FLAT_NAMES)})

    return records.select("file", "record_type", "seq", "ts_unix_ns", "payload", "block_offset", "position").mapInPandas(rows, FLAT)


def exemplars(ids: str, position: str) -> Column:
    """Aggregate: the first row's id, and the last later one that isn't empty or all zeros. Of no more than two ids whatever a group's size."""
    good = F.when(~F.col(ids).rlike("^0*$"), F.struct(position, ids))
    last = F.max(good)
    return F.when(last[position] > F.min(position), F.array(F.min_by(ids, position), last[ids])).otherwise(F.array(F.min_by(ids, position)))


def _form(body: str) -> Column:
    return F.coalesce(F.when(dedup.shape(body) == "json", dedup.json_text(body)), dedup.canonical(body), F.lit(""))


_KEPT = ("n", "first_seen", "last_seen", "first_pos", "trace_ids", "span_ids", "form", "shape")


def _together(df: DataFrame, keys: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """Groups of groups: counts add up, spans widen, all else is the first group's."""
    firsts = [F.min_by(c, "first_pos").alias(c) for c in kept if c not in ("n", "first_seen", "last_seen", "first_pos")]
    return df.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), *firsts, F.min("first_pos").alias("first_pos"))


def distinct(flat: DataFrame, matcher: str = "hash2", bucket: str = "global", threshold: float = 0.7, depth: int = 4, delimiters: Sequence[str] = ()) -> DataFrame:
    """Groups of log records over the whole selection: bucket columns, n, first_seen, last_seen, first_pos, trace_ids, span_ids, form and shape (null for
    ``exact``), template and cluster (null unless mined), signed (the text whose hash is the signature).

    ``exact`` groups equal bodies, ``hash2`` also equal canonical forms, ``full`` also mines what is then still alone in its bucket. Exemplars are those of the
    first group of equal bodies. Empty selections have no groups.
    """
    if matcher not in MATCHERS:
        raise ValueError(f"matcher must be one of {', '.join(MATCHERS)}")
    keys = BUCKETS[bucket]
    rows = flat.filter(~F.col("passes"))
    exact = rows.groupBy(*keys, "body").agg(
        F.count(F.lit(1)).alias("n"), F.min("seen_ns").alias("first_seen"), F.max("seen_ns").alias("last_seen"), F.min("pos").alias("first_pos"), exemplars("trace", "pos").alias("trace_ids"), exemplars("span", "pos").alias("span_ids")
    )
    text, number = F.lit(None).cast("string"), F.lit(None).cast("long")
    if matcher == "exact":
        return exact.select(*keys, *_KEPT[:-2], text.alias("form"), text.alias("shape"), text.alias("template"), number.alias("cluster"), F.col("body").alias("signed"))
    merged = _together(exact.withColumn("form", _form("body")).withColumn("shape", dedup.shape("body")), [*keys, "form"], [c for c in _KEPT if c != "form"])
    plain = merged.select(*keys, *_KEPT, text.alias("template"), number.alias("cluster"), F.col("form").alias("signed"))
    if matcher == "hash2":
        return plain
    plain = plain.persist()  # mining reads it several times, and each time would make all forms again
    alone = ordering.numbered(plain.filter("n = 1").drop("template", "cluster").withColumn("__seq", F.col("first_pos.seq")), ["__seq", "first_pos"], out="__no").drop("__seq")
    name = F.to_json(F.struct(*keys)) if keys else F.lit("")
    found = templates.assigned(alone.select(name.alias("bucket"), F.col("__no").alias("pos"), F.col("form").alias("body")), threshold, depth, delimiters)
    alone = alone.join(found.select(F.col("pos").alias("__no"), "cluster", "template"), "__no")
    last = F.max_by("template", "__no").alias("template")
    mined = _together(alone, [*keys, "cluster"], _KEPT).join(alone.groupBy("cluster").agg(last), "cluster")
    many = F.col("n") > 1
    mined = mined.select(*keys, *_KEPT, F.when(many, F.col("template")).alias("template"), F.when(many, F.col("cluster")).alias("cluster"), F.when(many, F.col("template")).otherwise(F.col("form")).alias("signed"))
    return plain.filter("n > 1").unionByName(mined)


def _payload(first: dict, extra: list[tuple[str, object]]) -> bytes:
    """A request of one log record: ``first``'s, with attributes added, its group's times, and neither flags nor scope version."""
    e = otlp.encoded
    attributes = [e(6, bytes(a)) for a in first["attributes"]] + [e(6, otlp.entry(k, v)) for k, v in extra]
    record = otlp.encoded_fixed(1, first["first_seen"]) + e(2, first["severity_number"]) + e(3, first["severity_text"]) + e(5, e(1, first["body"], True), True) + b"".join(attributes)
    record += e(9, bytes.fromhex(first["trace"])) + e(10, bytes.fromhex(first["span"])) + otlp.encoded_fixed(11, first["last_seen"]) + e(12, first["event_name"])
    scope = e(1, first["scope_name"]) + b"".join(e(3, bytes(a)) for a in first["scope_attributes"])
    resource = b"".join(e(1, bytes(a)) for a in first["resource_attributes"])
    return e(1, e(1, resource, True) + e(2, e(1, scope, True) + e(2, record, True), True), True)


def emitted(groups: DataFrame, flat: DataFrame, behaviour: str, matcher: str) -> DataFrame:
    """(record_type, seq, ts_unix_ns, payload): a log request for each group, and the records that pass, by time and numbered from 0.

    To its first record's attributes a group adds twelve ``dedup.*`` ones, and up to four that only its matcher has (canonical_body, body_shape,
    drain3_template, drain3_cluster_id). Equal times: groups before records that pass, each in order of place.
    """
    names = ("distinct", "global", "whole-selection"), ("collapse", "bucketed", "consecutive-run")
    scope, window = next((n[1:] for n in names if n[0] == behaviour), ("unknown", "unknown"))
    own = "pos severity_number severity_text scope_name event_name trace span body resource_attributes scope_attributes attributes".split()
    rows = groups.select(F.col("first_pos").alias("pos"), "n", "first_seen", "last_seen", "trace_ids", "span_ids", "form", "shape", "template", "cluster", "signed").join(flat.filter(~F.col("passes")).select(*own), "pos")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                used = "drain3" if r["template"] is not None and matcher == "full" else "canon" if matcher == "full" else matcher
                extra = [
                    ("dedup.count", r["n"]), ("dedup.mode", f"{behaviour}/{used}"), ("dedup.behaviour", behaviour), ("dedup.matcher", used), ("dedup.scope", scope), ("dedup.window", window),
                    ("dedup.signature", f"{xxhash.xxh3_64_intdigest(r['signed'].encode()):016x}"), ("dedup.first_seen_ns", r["first_seen"]), ("dedup.last_seen_ns", r["last_seen"]),
                    ("dedup.time_span_ms", max(0, r["last_seen"] - r["first_seen"]) // 10**6), ("dedup.exemplar_trace_ids", ",".join(r["trace_ids"])), ("dedup.exemplar_span_ids", ",".join(r["span_ids"])),
                ]
                optional = ("dedup.canonical_body", r["form"]), ("dedup.body_shape", r["shape"]), ("dedup.drain3_template", r["template"]), ("dedup.drain3_cluster_id", None if pd.isna(r["cluster"]) else int(r["cluster"]))
                out.append(("logs", r["first_seen"], _payload(r, extra + [o for o in optional if o[1] is not None]), r["pos"]))
            yield pd.DataFrame(out, columns=["record_type", "ts_unix_ns", "payload", "pos"])

    place = FLAT.split(", passes")[0]
    made = rows.mapInPandas(write, f"record_type string, ts_unix_ns long, payload binary, {place}").withColumn("late", F.lit(0))
    rest = flat.filter("passes").select("record_type", "ts_unix_ns", "payload", "pos", F.lit(1).alias("late"))
    every = made.unionByName(rest).persist()  # numbering reads it more than once, and each time would read all payloads again
    out = ordering.numbered(every, ["ts_unix_ns", "late", "pos"])
    return out.select("record_type", (F.col("row_no") - 1).cast("long").alias("seq"), "ts_unix_ns", "payload")


def deduplicated(records: DataFrame, matcher: str = "hash2", bucket: str = "global", **mining) -> DataFrame:
    """Records of block files with equal log records as one: ``unpacked``, ``distinct``, ``emitted``. Payloads are read three times; checkpoint ``unpacked``'s rows
    and call the three to read them once."""
    flat = unpacked(records)
    return emitted(distinct(flat, matcher, bucket, **mining), flat, "distinct", {"hash2": "canon"}.get(matcher, matcher))
