"""Discovery over many files: what each holds and how much of it matches, reading only the blocks that may match.

An index has a row per block (bounds of sequence and time, record types, at most sixteen services and severities with a flag whether
these are all). Blocks that can't hold a match are not read, and a file without any other is marked as skipped. Pruning changes no count of matches,
only ``records_scanned``: a block is ruled out by services or severities only if each of its records has some.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.operators import predicates, summary
from tallybrook.sources import otlp

#: Bits of record types, as in a block index.
TYPE_BITS = {"logs": 1, "metrics": 2, "traces": 4, "events": 8}
EVENTS = "array<struct<service:string,severity:string>>"


def index_of(df: DataFrame, file: str, block: str, position: str, seq: str, ts: str, service: str, severity: str) -> DataFrame:
    """Index rows of log events in a table, ``block`` in place of a block's offset."""
    few = lambda c: F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit(""))))
    rows = df.groupBy(F.col(file).alias("file"), F.col(block).alias("block_offset")).agg(
        F.count(F.lit(1)).alias("records"),
        *[f(c, position).alias(f"{name}_{n}") for c, n in ((seq, "seq"), (ts, "ts")) for f, name in ((F.min_by, "first"), (F.max_by, "last"))],
        *[f(c).alias(f"{name}_{n}") for c, n in ((seq, "seq"), (ts, "ts")) for f, name in ((F.min, "min"), (F.max, "max"))],
        F.lit(TYPE_BITS["logs"]).alias("types"),
        *[x for c, n in ((service, "services"), (severity, "severities")) for x in (few(c).alias(n), F.count_if(F.nullif(F.col(c), F.lit("")).isNull()).alias("no_service" if n == "services" else "no_severity"))],
    )
    for n in ("services", "severities"):
        rows = rows.withColumn(f"{n}_complete", F.size(n) <= summary.DISTINCT_LIMIT).withColumn(n, F.slice(n, 1, summary.DISTINCT_LIMIT))
    return rows


def may_match(types: Sequence[str] | None = None, seq_min: int | None = None, seq_max: int | None = None, ts_min: int | None = None, ts_max: int | None = None, services: Sequence[str] | None = None, severities: Sequence[str] | None = None) -> Column:
    """Whether an index row's block can hold a record that matches."""
    out = F.lit(True)
    if types is not None:
        out &= F.col("types").bitwiseAND(sum(TYPE_BITS[t] for t in set(types))) != 0
    for bound, column, least in ((seq_min, "max_seq", True), (seq_max, "min_seq", False), (ts_min, "max_ts", True), (ts_max, "min_ts", False)):
        if bound is not None:
            out &= F.col(column) >= bound if least else F.col(column) <= bound
    for values, column, none in ((services, "services", "no_service"), (severities, "severities", "no_severity")):
        if values is not None:
            out &= ~F.col(f"{column}_complete") | (F.col(none) > 0) | F.arrays_overlap(column, F.array(*map(F.lit, values)))
    return F.coalesce(out, F.lit(False))


def with_events(records: DataFrame) -> DataFrame:
    """Records of block files (file, record_type, seq, ts_unix_ns, payload) with ``events``: service and severity of each log record; none where a payload can't be read."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            events = [[{"service": s, "severity": t} for s, t in otlp.log_events(p)] if k == "logs" else [] for k, p in zip(b.column(1).to_pylist(), b.column(4).to_pylist(), strict=True)]
            kind = pa.list_(pa.struct([("service", pa.string()), ("severity", pa.string())]))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(events, kind)], names=["file", "record_type", "seq", "ts_unix_ns", "events"])

    return records.select("file", "record_type", "seq", "ts_unix_ns", "payload").mapInArrow(rows, f"file string, record_type string, seq long, ts_unix_ns long, events {EVENTS}")


def discover(
    index: DataFrame,
    records_at: Callable[[DataFrame], DataFrame],
    types: Sequence[str] | None = None,
    seq_min: int | None = None,
    seq_max: int | None = None,
    ts_min: int | None = None,
    ts_max: int | None = None,
    services: Sequence[str] | None = None,
    severities: Sequence[str] | None = None,
    offset: int = 0,
    limit: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(files, events): a row per file of the page, and the counts of matching log events as (kind, value, n).

    ``records_at`` gives the records (file, record_type, seq, ts_unix_ns, events) of chosen index rows. A record matches by type, sequence, time, and
    if none of its services or severities is outside the given ones; its events count if they have a given service and severity. Files come
    in order of their names, from ``offset`` on; an offset past the end, an empty page and empty values are errors before anything is read.
    """
    for values in (services, severities):
        if values is not None and (not values or not all(v.strip() for v in values)):
            raise ValueError("values must not be empty")
    if limit is not None and limit <= 0:
        raise ValueError("limit must be greater than zero")
    names = index.select("file").distinct()
    if offset and offset > names.count():
        raise ValueError(f"offset {offset} is past the end of the files")
    if offset or limit is not None:
        page = names.orderBy("file").offset(offset)
        index = index.join(page.limit(limit) if limit is not None else page, "file", "left_semi")
    bounds = {"types": types, "seq_min": seq_min, "seq_max": seq_max, "ts_min": ts_min, "ts_max": ts_max, "services": services, "severities": severities}
    index = index.withColumn("may", may_match(**bounds))
    place = ["file", "block_offset"]
    files = index.groupBy("file").agg(
        (~F.bool_or("may")).alias("skipped_by_index"),
        F.coalesce(F.sum(F.when(F.col("may"), F.col("records"))), F.lit(0)).cast("long").alias("records_scanned"),
        *[F.min_by(c, "block_offset").alias(f"source_{c}") for c in ("first_seq", "first_ts")],
        *[F.max_by(c, "block_offset").alias(f"source_{c}") for c in ("last_seq", "last_ts")],
    )
    rows = records_at(index.filter("may").select(*place, *[c for c in ("length",) if c in index.columns]))
    condition = predicates.between("seq", seq_min, seq_max) & predicates.between("ts_unix_ns", ts_min, ts_max)
    if types is not None:
        condition &= F.col("record_type").isin(*types)
    counted = F.col("events")
    for values, field in ((services, "service"), (severities, "severity")):
        if values is not None:
            known = lambda e, field=field: F.coalesce(e[field], F.lit(""))
            condition &= F.forall("events", _check(known, values, True))
            counted = F.filter(counted, _check(known, values, False))
    matched = rows.filter(condition).withColumn("counted", F.when(F.col("record_type") == "logs", counted).otherwise(F.array().cast(EVENTS)))
    stats = matched.groupBy("file").agg(F.count(F.lit(1)).alias("records_matched"), F.sum(F.size("counted")).cast("long").alias("log_events"), F.min("ts_unix_ns").alias("first_ts"), F.max("ts_unix_ns").alias("last_ts"))
    files = files.join(stats, "file", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("records_matched", "log_events")})
    each = matched.select(F.explode("counted").alias("e")).select(F.explode(F.array(F.struct(F.lit("service").alias("kind"), F.col("e.service").alias("value")), F.struct(F.lit("severity").alias("kind"), F.coalesce(F.nullif(F.col("e.severity"), F.lit("")), F.lit("<unset>")).alias("value")))).alias("x"))
    events = each.select("x.*").filter("value is not null").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
    return files, events


def _check(known: Callable[[Column], Column], values: Sequence[str], unset: bool) -> Callable[[Column], Column]:
    """A condition on an event's field: one of ``values``, or with ``unset`` none at all."""
    return (lambda e: known(e).isin(*values) | (known(e) == "")) if unset else (lambda e: known(e).isin(*values))


def rows_of(files: DataFrame) -> DataFrame:
    """A row per file (kind file), and one for all (kind summary): the line-wise response."""
    names = ["records_scanned", "records_matched", "log_events", "first_ts", "last_ts"]
    whole = files.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names[:3]], F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    out = files.select(F.lit("file").alias("kind"), F.col("file").alias("name"), *names, "skipped_by_index")
    return out.unionByName(whole.select(F.lit("summary").alias("kind"), F.lit("").alias("name"), *names, F.lit(None).cast("boolean").alias("skipped_by_index")))


def response(files: DataFrame, events: DataFrame, total: int, offset: int = 0, limit: int | None = None, top: int = 10) -> DataFrame:
    """The nested response: one row ``response`` of JSON, with the page's files in it; for pages of bounded size, else see ``rows_of``."""
    span = lambda a, b: F.struct(F.col(a).alias("first"), F.col(b).alias("last"))
    file = F.struct(F.col("file").alias("path"), span("source_first_seq", "source_last_seq").alias("source_sequence_span"), span("source_first_ts", "source_last_ts").alias("source_time_span_unix_ns"), "records_scanned", "records_matched", "log_events", span("first_ts", "last_ts").alias("time_span_unix_ns"), "skipped_by_index")
    whole = rows_of(files).filter("kind = 'summary'").drop("kind", "name", "skipped_by_index")
    listed = files.agg(F.array_sort(F.collect_list(file)).alias("files"))
    counts = lambda kind, order, k: events.filter(F.col("kind") == kind).orderBy(*order).limit(k).agg(F.collect_list(F.struct("n", "value")).alias(kind))
    one = whole.join(listed).join(counts("service", [F.col("n").desc(), "value"], top)).join(counts("severity", ["value"], 1 << 16))  # one row each
    entry = lambda c: F.transform(c, lambda x: F.struct(x["value"].alias("value"), x["n"].alias("count")))
    by_count = F.array_sort("service", lambda a, b: F.when(a["n"] > b["n"], -1).when(a["n"] < b["n"], 1).when(a["value"] < b["value"], -1).when(a["value"] > b["value"], 1).otherwise(0))
    by_value = F.array_sort("severity", lambda a, b: F.when(a["value"] < b["value"], -1).when(a["value"] > b["value"], 1).otherwise(0))
    scanned = F.size("files")
    page = F.struct(F.lit(total).alias("files_total"), F.lit(offset).alias("offset"), F.lit(limit).alias("limit"), scanned.alias("files_scanned"), F.when(scanned + offset < total, scanned + offset).alias("next_offset"))
    told = F.struct("records_scanned", "records_matched", "log_events", span("first_ts", "last_ts").alias("time_span_unix_ns"), entry(by_count).alias("top_services"), entry(by_value).alias("severity_breakdown"))
    return one.select(F.to_json(F.struct(F.lit(True).alias("ok"), F.lit("discover").alias("command"), F.lit(1).alias("format_version"), page.alias("input"), told.alias("summary"), "files"), {"ignoreNullFields": "false"}).alias("response"))
