"""Tables of an analysed system trace, exported to files or a database, as log records, spans and gauges.

Every table may hold many traces, told apart by a ``trace`` column (absent: one trace, ''). Nothing here needs a trace in one task: events
of all kinds are one union of narrow rows, their clock (``parsers.unix_ns``) and places (``ordering.numbered``) go by ranges.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybrook.operators import ordering, parsers
from tallybrook.sources.otlp import encoded, encoded_fixed, entry

#: Tables of an export, their columns and the columns that order them.
TABLES = {
    "slice": ("id long, ts long, dur long, name string, parent_id long, track_id long, arg_set_id long, depth int", "ts"),
    "flow": ("id long, slice_out long, slice_in long", "id"),
    "process": ("upid long, name string, pid long", "upid"),
    "thread": ("utid long, name string, tid long, upid long, is_main_thread int", "utid"),
    "__intrinsic_track": ("id long, name string, type string, utid long, upid long", "id"),
    "args": ("arg_set_id long, flat_key string, string_value string, int_value long, real_value double", "arg_set_id flat_key"),
    "clock_snapshot": ("ts long, clock_name string, clock_value long", "ts"),
    "sched_slice": ("id long, ts long, dur long, utid long, ucpu long, end_state string", "ts"),
    "thread_state": ("id long, ts long, dur long, utid long, state string, io_wait int, blocked_function string, waker_utid long, cpu long", "ts"),
    "ftrace_event": ("id long, ts long, name string, cpu long, utid long", "ts"),
    "spurious_sched_wakeup": ("id long, ts long, utid long, waker_utid long", "ts"),
    "instant": ("ts long, track_id long, name string", "ts"),
    "counter": ("id long, ts long, track_id long, value double", "ts"),
    "cpu": ("id long, cpu long, cluster_id long, processor string", "id"),
    "machine": ("id long, arch string, num_cpus long, sysname string, release string", "id"),
    "metadata": ("name string, int_value long, str_value string", "name"),
    "memory_snapshot": ("id long, timestamp long, track_id long, detail_level string", "id"),
    "cpu_profile_stack_sample": ("id long, ts long, callsite_id long, utid long", "ts"),
    "stack_profile_frame": ("id long, name string, mapping_id long", "id"),
    "heap_profile_allocation": ("id long, ts long, upid long, size long, count long", "ts"),
    "protolog": ("id long, ts long, level string, tag string, message string", "ts"),
    "android_logs": ("id long, ts long, utid long, prio long, tag string, msg string", "ts"),
    "filedescriptor": ("id long, ufd long, fd long, ts long, upid long, path string", "ts"),
}
#: Prefix of attribute keys, service name, and spans of a batch.
PREFIX, SERVICE, BATCH = "perfetto.", "perfetto", 200
ATTRIBUTES = "array<struct<key:string,string_value:string,int_value:bigint>>"


def typed(df: DataFrame, name: str) -> DataFrame:
    """``trace`` and the table's columns with their types; null where ``df`` lacks one, without its other columns."""
    column = lambda c, kind: (F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c)
    trace = (F.coalesce(F.col("trace").cast("string"), F.lit("")) if "trace" in df.columns else F.lit("")).alias("trace")
    return df.select(trace, *[column(*c.split()) for c in TABLES[name][0].split(", ")])


def read(spark: SparkSession, folder: str, name: str, format: str = "parquet", **options: str) -> DataFrame:
    """A table out of ``folder``/``name``, or of a database where ``format`` is jdbc (``options``: url, driver and so on)."""
    reader = spark.read.format(format).options(**options)
    return typed(reader.option("dbtable", name).load() if format == "jdbc" else reader.load(f"{folder}/{name}"), name)


def ordered(df: DataFrame, name: str) -> DataFrame:
    """The table's rows by trace and the table's order, equal ones by their further columns."""
    first = TABLES[name][1].split()
    return df.orderBy("trace", *first, *[c.split()[0] for c in TABLES[name][0].split(", ") if c.split()[0] not in first])


def realtime(snapshots: DataFrame) -> DataFrame:
    """Clock snapshots (trace, ts, unix) of the real-time clock."""
    return typed(snapshots, "clock_snapshot").filter("clock_name = 'REALTIME'").select("trace", "ts", F.col("clock_value").alias("unix"))


def argument_sets(args: DataFrame) -> DataFrame:
    """(trace, arg_set_id, arguments): each set of arguments as a map from key to (string_value, int_value, real_value).

    Rows without set or key are left out; of rows with the same key the least value stays (null before others), so repeated rows don't
    count. Values are folded per key before the shuffle by set; a set is one row, as long as its different keys.
    """
    rows = typed(args, "args").filter("arg_set_id is not null and flat_key is not null")
    one = rows.groupBy("trace", "arg_set_id", "flat_key").agg(F.min(F.struct("string_value", "int_value", "real_value")).alias("value"))
    entries = F.array_sort(F.collect_list(F.struct(F.col("flat_key").alias("key"), "value")))
    return one.groupBy("trace", "arg_set_id").agg(F.map_from_entries(entries).alias("arguments"))


def with_arguments(df: DataFrame, args: DataFrame) -> DataFrame:
    """Adds ``arguments`` of each row's ``arg_set_id``, null where there are none."""
    sets = argument_sets(args).withColumnsRenamed({"trace": "__trace", "arg_set_id": "__set"})
    return df.join(sets, (F.col("trace") == F.col("__trace")) & (F.col("arg_set_id") == F.col("__set")), "left").drop("__trace", "__set")


def micros_text(ns: Column) -> Column:
    """A duration in microseconds with one digit, or 'running' below 0.

    Rounded from the double that ns / 1000 is, exactly, halves to even: from 32 ns on its fraction times 2^57 is a whole number, below that it
    rounds to 0 anyway. Without conditions and in whole numbers, since Spark repeats a column wherever it is used: what is long isn't compiled.
    """
    whole = F.floor(ns / 1000.0)
    tenths = ((ns / 1000.0 - whole) * F.lit(float(1 << 57))).cast("long") * 10
    digit = F.shiftright(tenths + F.lit((1 << 56) - 1) + F.shiftright(tenths, 57) % 2, 57)
    return F.when(ns < 0, "running").otherwise(F.concat((whole + (digit == 10).cast("long")).cast("string"), F.lit("."), (digit % 10).cast("string"), F.lit("us")))


def _attributes(group: str, **values: Column) -> Column:
    """Attributes of a group, without those whose value is null; texts are columns named with a leading underscore."""
    items = []
    for name, v in values.items():
        is_text = name.startswith("_")
        key = F.lit(f"{PREFIX}{group}.{name.lstrip('_')}").alias("key")
        text, number = (v, F.lit(None)) if is_text else (F.lit(None), v)
        items.append(F.when(v.isNotNull(), F.struct(key, text.cast("string").alias("string_value"), number.cast("long").alias("int_value"))))
    return F.filter(F.array(*items), lambda a: a.isNotNull()).cast(ATTRIBUTES)


def _part(label: str, value: Column) -> Column:
    """Label and value, nothing for null."""
    return F.coalesce(F.concat(F.lit(label), value.cast("string")), F.lit(""))


def _slice() -> tuple[Column, Column]:
    name = F.coalesce("name", F.lit("(unnamed)"))
    body = F.concat(name, F.lit("  dur="), micros_text(F.col("dur")), _part("  depth=", F.col("depth")))
    return body, _attributes("slice", id=F.col("id"), _name=name, dur_ns=F.col("dur"), depth=F.col("depth"))


def _sched_slice() -> tuple[Column, Column]:
    end = F.coalesce("end_state", F.lit("?"))
    body = F.concat(_part("cpu=", F.col("ucpu")), F.lit(" state="), end, _part(" utid=", F.col("utid")), F.lit("  dur="), micros_text(F.col("dur")))
    return body, _attributes("sched", id=F.col("id"), cpu=F.col("ucpu"), dur_ns=F.col("dur"), _end_state=end)


def _thread_state() -> tuple[Column, Column]:
    state = F.coalesce("state", F.lit("?"))
    waits = F.when(F.col("io_wait") != 0, " io_wait").otherwise("")
    body = F.concat(F.lit("state="), state, F.lit(" dur="), micros_text(F.col("dur")), _part(" utid=", F.col("utid")), _part(" cpu=", F.col("cpu")), waits, _part(" blocked=", F.col("blocked_function")), _part(" waker=", F.col("waker_utid")))
    io = (F.col("io_wait") != 0).cast("int")
    return body, _attributes("ts", id=F.col("id"), _state=state, dur_ns=F.col("dur"), utid=F.col("utid"), cpu=F.col("cpu"), io_wait=io, _blocked_function=F.col("blocked_function"))


def _ftrace_event() -> tuple[Column, Column]:
    name, cpu = F.coalesce("name", F.lit("?")), F.coalesce("cpu", F.lit(-1))
    return F.concat(name, _part(" cpu=", cpu)), _attributes("ftrace", id=F.col("id"), _name=name, cpu=cpu, utid=F.col("utid"))


def _spurious_wakeup() -> tuple[Column, Column]:
    return _part("spurious_wakeup utid=", F.coalesce("utid", F.lit(-1))), _attributes("sw", id=F.col("id"), utid=F.col("utid"), waker_utid=F.col("waker_utid"))


def _instant() -> tuple[Column, Column]:
    name = F.coalesce("name", F.lit("?"))
    return name, _attributes("instant", _name=name, track_id=F.col("track_id"))


#: Kinds of events: table, and its body and attributes. Events at the same time are in this order.
KINDS = {"slice": _slice, "sched_slice": _sched_slice, "thread_state": _thread_state, "ftrace_event": _ftrace_event, "spurious_sched_wakeup": _spurious_wakeup, "instant": _instant}


def events(tables: dict[str, DataFrame], clock: DataFrame) -> DataFrame:
    """Rows of the six kinds as log records: trace, kind, kind_no, id, ts, body, attributes, unix_ns.

    ``tables`` by name, any may be absent; ``clock``: see ``realtime``. Time is 0 in a trace without snapshots. Missing names and states are
    '(unnamed)' or '?', a null duration or time 0; instants have no id. Repeated rows are events of their own, and empty tables give none.
    """
    parts = []
    for number, (kind, made) in enumerate(KINDS.items()):
        if kind not in tables:
            continue
        rows = typed(tables[kind], kind).withColumn("ts", F.coalesce("ts", F.lit(0)))
        rows = rows.withColumn("dur", F.coalesce("dur", F.lit(0))) if "dur" in rows.columns else rows
        body, attributes = made()
        number_of = F.col("id") if "id" in rows.columns else F.lit(None).cast("long")
        parts.append(rows.select("trace", F.lit(kind).alias("kind"), F.lit(number).alias("kind_no"), number_of.alias("id"), "ts", body.alias("body"), attributes.alias("attributes")))
    if not parts:
        raise ValueError("none of the tables " + ", ".join(KINDS))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return parsers.unix_ns(every, clock)


def placed(found: DataFrame) -> DataFrame:
    """Adds ``place``, from 1 within each trace: by time, then kind, then the tables' own order; equal rows in any order.

    Events at time 0 (all of a trace without snapshots) are dealt into ranges by kind and the trace's own time, so that they aren't one range.
    Attributes order what is equal but for them; without that column they aren't moved.
    """
    own = F.greatest(F.lit(-(1 << 58)), F.least(F.lit((1 << 58) - 1), F.col("ts")))
    key = F.when(F.col("unix_ns") > 0, F.col("unix_ns")).otherwise(F.lit(-(1 << 62)) + F.col("kind_no").cast("long") * F.lit(1 << 59) + own)
    order = ["__at", "kind_no", "ts", "id", "body", *(["attributes"] if "attributes" in found.columns else [])]  # times of 0 have keys below 0
    return ordering.numbered(found.withColumn("__at", key), order, "trace", "place").drop("__at")


def totals(tables: dict[str, DataFrame], found: DataFrame) -> DataFrame:
    """A last record for each trace: counts of slices, threads and processes, just after the last event (0 without events)."""
    counts = [typed(tables[t], t).select("trace", F.lit(t).alias("t"), F.lit(None).cast("long").alias("at")) for t in ("slice", "thread", "process") if t in tables]
    rows = found.select("trace", F.lit("").alias("t"), F.col("unix_ns").alias("at"))
    for c in counts:
        rows = rows.unionByName(c)
    each = lambda t: F.count_if(F.col("t") == t)
    out = rows.groupBy("trace").agg(each("slice").alias("slices"), each("thread").alias("threads"), each("process").alias("processes"), F.coalesce(F.max("at") + 1, F.lit(0)).alias("unix_ns"))
    body = F.format_string("Perfetto trace analysis complete: %d slices, %d threads, %d processes", "slices", "threads", "processes")
    return out.withColumn("body", body)


def requests(found: DataFrame) -> DataFrame:
    """Events (trace, ts, unix_ns, body, attributes) as records with a log request each: trace, record_type, ts_unix_ns, payload."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        resource = encoded(1, encoded(1, entry("service.name", SERVICE)))
        for b in batches:
            out = []
            for trace, at, body, attributes in zip(b["trace"], b["unix_ns"], b["body"], b["attributes"], strict=True):
                record = encoded_fixed(1, int(at)) + encoded(2, 9) + encoded(3, "INFO") + encoded(5, encoded(1, body))
                for a in attributes:
                    record += encoded(6, entry(a["key"], a["string_value"] if a["int_value"] is None else int(a["int_value"])))
                record += encoded_fixed(11, int(at))
                out.append((trace, "logs", at, encoded(1, resource + encoded(2, encoded(2, record)))))
            yield pd.DataFrame(out, columns=["trace", "record_type", "ts_unix_ns", "payload"])

    return found.select("trace", "unix_ns", "body", "attributes").mapInPandas(rows, "trace string, record_type string, ts_unix_ns long, payload binary")


def _id_text(number: Column) -> Column:
    """Eight bytes, least first, as hex digits."""
    return F.regexp_replace(F.lower(F.lpad(F.hex(number), 16, "0")), "(..)" * 8, "$8$7$6$5$4$3$2$1")


def spans(slices: DataFrame, clock: DataFrame) -> DataFrame:
    """Slices as spans: trace, trace_id, span_id, parent_span_id (empty: none), name, start_ns, end_ns, attributes, batch, batch_ns.

    Batches are runs of 200 spans in order of time within a trace, ``batch_ns`` is the first start in one. A trace without clock snapshots has
    no spans. A slice without name is named by its id; null times and durations are 0. Repeated rows are spans of their own.
    """
    rows = typed(slices, "slice").withColumn("ts", F.coalesce("ts", F.lit(0))).withColumn("dur", F.coalesce("dur", F.lit(0)))
    rows = rows.join(clock.select("trace").distinct(), "trace", "left_semi")
    rows = ordering.numbered(rows, ["ts", "id", "name", "dur", "track_id", "depth", "parent_id", "arg_set_id"], "trace", "place")
    rows = parsers.unix_ns(rows.withColumn("batch", F.floor((F.col("place") - 1) / BATCH).cast("long")), clock).withColumnRenamed("unix_ns", "start_ns")
    rows = rows.withColumn("batch_ns", F.min("start_ns").over(Window.partitionBy("trace", "batch"))).withColumn("end", F.col("ts") + F.col("dur"))
    rows = parsers.unix_ns(rows, clock, "end").withColumnRenamed("unix_ns", "end_ns")
    text = lambda c: F.col(c).cast("string")
    attributes = _attributes("slice", _id=text("id"), _ts=text("ts"), _dur_ns=text("dur"), _track_id=text("track_id"), depth=F.col("depth"))
    return rows.select(
        "trace",
        F.md5("trace").alias("trace_id"),
        _id_text(F.col("id")).alias("span_id"),
        F.coalesce(_id_text(F.col("parent_id")), F.lit("")).alias("parent_span_id"),
        F.coalesce("name", F.concat(F.lit("slice-"), text("id"))).alias("name"),
        "start_ns",
        "end_ns",
        attributes.alias("attributes"),
        "batch",
        "batch_ns",
    )


def _walk(raw: str) -> list[tuple]:
    """(name, description, unit, value, labels) of each number in a tree of metrics, outer ones first, keys in order."""

    def not_json(text: str):
        raise ValueError(f"not JSON: {text}")

    root = json.loads(raw, parse_constant=not_json)
    if not isinstance(root, dict):
        raise ValueError("not an object")
    text = lambda v: v if isinstance(v, str) else ""
    number = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
    out, todo = [], [(k, root[k]) for k in sorted(root, reverse=True)]
    while todo:
        name, v = todo.pop()
        own = v if isinstance(v, dict) else {"value": v}
        value = number(own.get("value"))
        if value is not None:
            labels = {k: x for k, x in own.items() if isinstance(x, str) and k not in ("value", "description", "unit")}
            out.append((name, text(own.get("description")), text(own.get("unit")), value, labels))
        if own is v:
            todo += [(f"{name}.{k}", v[k]) for k in sorted(v, reverse=True) if isinstance(v[k], dict)]
    return out


def gauges(df: DataFrame, key: str, column: str) -> DataFrame:
    """Gauges out of metrics as JSON: the key, position, name (dotted path), description, unit, value, labels, error.

    An object with a number as its ``value``, and a number at the top, is a gauge; its other texts are labels; objects within are looked
    into at any depth. A text that isn't an object in JSON (null and empty ones too) gives one row with only ``error``; one without numbers gives none.
    """
    kind = df.schema[key].dataType.simpleString()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, raw in zip(b["__key"], b["__raw"], strict=True):
                try:
                    out += [(k, i, *g, None) for i, g in enumerate(_walk(raw or ""))]
                except (ValueError, RecursionError, OverflowError) as e:
                    out.append((k, None, None, None, None, None, None, str(e)))
            got = pd.DataFrame(out, columns=["__key", "position", "name", "description", "unit", "value", "labels", "error"])
            yield got.astype({"position": "Int64", "value": "Float64"})

    found = df.select(F.col(key).cast("string").alias("__key"), F.col(column).cast("string").alias("__raw"))
    found = found.mapInPandas(rows, "__key string, position long, name string, description string, unit string, value double, labels map<string,string>, error string")
    return found.withColumn("__key", F.col("__key").cast(kind)).withColumnRenamed("__key", key)
