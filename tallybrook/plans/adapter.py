"""The star-schema test tables seen as telemetry: log events, metric points, spans, lines.

Each view comes with SQL text for the same rows, so that queries over it can be checked.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.sources.otlp import encoded, encoded_fixed, entry

#: Severity of each event type.
SEVERITIES = {"error": ("ERROR", 17), "purchase": ("WARN", 13), "signup": ("INFO", 9), "click": ("DEBUG", 5), "view": ("TRACE", 1)}

#: Lines that a task joins with their orders; where there are fewer in all, Spark chooses the join.
JOIN_LINES = 1_000_000


def micros(column: str) -> Column:
    """Microseconds since 1970 of a time without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})")


def _case(column, i: int):
    out = None
    for k, v in SEVERITIES.items():
        out = (F if out is None else out).when(column == k, v[i])
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, kind = table(spark, sf_dir, "events"), F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("seq"),
        (micros("ts") * 1000).alias("ts_ns"),
        "ts",
        _case(kind, 0).alias("severity_text"),
        _case(kind, 1).alias("severity_number"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")).alias("service_name"),
        F.concat(kind, F.lit(" user="), F.col("user_id").cast("string"), F.lit(" k="), k.cast("string")).alias("body"),
        k.alias("k"),
        F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(".seg")).alias("file"),
        F.floor(F.col("event_id") / 10).cast("long").alias("batch"),
        kind,
        "user_id",
        "value",
    )


_SQL_CASE = lambda i: "CASE event_type " + " ".join(f"WHEN '{k}' THEN " + (f"'{v[i]}'" if isinstance(v[i], str) else str(v[i])) for k, v in SEVERITIES.items()) + " END"
LOGS = f"""logs AS (SELECT event_id AS seq, epoch_us(ts) * 1000 AS ts_ns, ts, {_SQL_CASE(0)} AS severity_text, {_SQL_CASE(1)} AS severity_number,
  'svc-' || (user_id % 5)::VARCHAR AS service_name, event_type || ' user=' || user_id::VARCHAR || ' k=' || (props->>'$.k') AS body, (props->>'$.k')::INT AS k,
  strftime(ts, '%Y-%m-%d') || '.seg' AS file, event_id // 10 AS batch, event_type, user_id, value FROM events)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as root spans, their lines as children."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("trace_id"), F.lit(0).cast("long").alias("span_id"), F.lit(None).cast("long").alias("parent_span_id"), F.col("o_orderpriority").alias("name"), (micros("o_orderdate") * 1000).alias("start_ns"), ((micros("o_orderdate") + 86_400_000_000) * 1000).alias("end_ns")
    )
    dates = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    lines = table(spark, sf_dir, "lineitem")
    parts = -(-lines.count() // JOIN_LINES)
    if parts > 1:  # few bytes of a file can be many orders: sent to every task, they would grow with the input
        lines, dates = lines.repartition(parts, "l_orderkey"), dates.repartition(parts, "l_orderkey").hint("merge")
    i = lines.join(dates, "l_orderkey")
    i = i.select(F.col("l_orderkey").alias("trace_id"), F.col("l_linenumber").cast("long").alias("span_id"), F.lit(0).cast("long").alias("parent_span_id"), F.concat(F.lit("ship "), F.col("l_returnflag")).alias("name"), (micros("o_orderdate") * 1000).alias("start_ns"), (micros("l_shipdate") * 1000).alias("end_ns"))
    return o.unionByName(i)


SPANS = """spans AS (SELECT o_orderkey AS trace_id, 0::BIGINT AS span_id, NULL::BIGINT AS parent_span_id, o_orderpriority AS name, epoch_us(o_orderdate) * 1000 AS start_ns, (epoch_us(o_orderdate) + 86400000000) * 1000 AS end_ns FROM orders
  UNION ALL SELECT l_orderkey, l_linenumber::BIGINT, 0::BIGINT, 'ship ' || l_returnflag, epoch_us(o_orderdate) * 1000, epoch_us(l_shipdate) * 1000 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


LINES = "lines AS (SELECT doc_id, (unnest(range(1, len(l) + 1)) - 1)::INT AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day of events as a segment of its service's stream, sized by its bodies."""
    return logs(spark, sf_dir).groupBy("service_name", "file").agg(F.count(F.lit(1)).alias("records"), F.sum(F.octet_length("body") + 21).cast("long").alias("size"), F.min_by("seq", "seq").alias("first_seq"), F.max_by("seq", "seq").alias("last_seq"))


SEGMENTS = LOGS + ", segments AS (SELECT service_name, file, count(*) AS records, sum(strlen(body) + 21)::BIGINT AS size, min(seq) AS first_seq, max(seq) AS last_seq FROM logs GROUP BY ALL)"


def log_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a record with a log request of its type and k, every seventh with a trace id of zeros; every fiftieth is a record of another kind."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = lru_cache(1 << 12)(entry)
        for b in batches:
            out = []
            for seq, at, body, service in zip(*(b[c].tolist() for c in ("seq", "ts_ns", "body", "service_name")), strict=True):
                trace = (seq if seq % 7 else 0).to_bytes(16, "big")
                record = encoded_fixed(1, at) + encoded(5, encoded(1, body)) + encoded(9, trace)
                request = encoded(1, encoded(1, encoded(1, known("service.name", service))) + encoded(2, encoded(2, record)))
                out.append(("events" if seq % 50 == 0 else "logs", seq, at, request))
            yield pd.DataFrame(out, columns=["record_type", "seq", "ts_unix_ns", "payload"])

    events = logs(spark, sf_dir).select("seq", "ts_ns", F.concat("event_type", F.lit(" k="), F.col("k").cast("string")).alias("body"), "service_name")
    records = events.mapInPandas(rows, "record_type string, seq long, ts_unix_ns long, payload binary")
    return records.select("*", F.lit("").alias("file"), F.lit(0).cast("long").alias("block_offset"), F.lit(0).alias("position"))


def span_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each span as a record with a trace request."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = lru_cache(1 << 12)(entry)
        for b in batches:
            out = []
            for trace, span, parent, name, start, end in zip(*(b[c].tolist() for c in ("trace_id", "span_id", "parent_span_id", "name", "start_ns", "end_ns")), strict=True):
                item = encoded(1, trace.to_bytes(16, "big")) + encoded(2, span.to_bytes(8, "big")) + (b"" if parent is None or parent != parent else encoded(4, int(parent).to_bytes(8, "big")))
                item += encoded(5, name) + encoded(6, span % 6) + encoded_fixed(7, start) + encoded_fixed(8, end) + encoded(9, known("line", span))
                out.append((trace, span, "traces", encoded(1, encoded(2, encoded(2, item)))))
            yield pd.DataFrame(out, columns=["trace_id", "span_id", "record_type", "payload"])

    return spans(spark, sf_dir).mapInPandas(rows, "trace_id long, span_id long, record_type string, payload binary")


def trace_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables as those of three traces: spans as slices, events as scheduling, orders as thread states, lines, customers and suppliers as the rest.

    Traces '0' and '1' have clock snapshots, trace '2' has none.
    """
    trace = lambda key: F.expr(f"cast({key} % 3 as string) as trace")
    s, e, o, i = spans(spark, sf_dir), table(spark, sf_dir, "events"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    c, u, n, p = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation", "part"))
    return {
        "slice": s.select(trace("trace_id"), F.expr("trace_id * 8 + span_id as id"), F.expr("(start_ns - 694224000000000000) div 1000 as ts"), F.expr("(end_ns - start_ns) div 86400000000000 * 1050 + trace_id * 25 - 100 as dur"), F.expr("if(span_id = 2, null, name) as name"), F.expr("if(span_id = 0, null, trace_id * 8) as parent_id"), F.expr("trace_id % 7 as track_id"), F.expr("if(span_id = 0, 0, 1) as depth")),
        "sched_slice": e.select(trace("event_id"), F.col("event_id").alias("id"), F.expr("event_id * 100000000000 as ts"), F.expr("event_id * 150 as dur"), F.col("user_id").alias("utid"), F.expr("user_id % 4 as ucpu"), F.expr("if(event_type = 'signup', null, event_type) as end_state")),
        "thread_state": o.select(trace("o_orderkey"), F.col("o_orderkey").alias("id"), F.expr("o_orderkey * 20000000000 as ts"), F.expr("o_custkey * 10 as dur"), F.col("o_custkey").alias("utid"), F.expr("nullif(o_orderstatus, 'P') as state"), F.expr("case o_orderkey % 5 when 0 then 0 when 1 then 1 end as io_wait"), F.expr("if(o_orderkey % 4 = 0, o_orderpriority, null) as blocked_function"), F.expr("if(o_orderkey % 7 = 0, o_custkey + 1, null) as waker_utid"), F.expr("if(o_orderkey % 2 = 0, o_custkey % 4, null) as cpu")),
        "ftrace_event": i.select(trace("l_orderkey"), F.expr("l_orderkey * 8 + l_linenumber as id"), F.expr("l_partkey * 100000000000 as ts"), F.expr("nullif(l_returnflag, 'A') as name"), F.expr("if(l_linenumber = 3, null, l_suppkey % 4) as cpu"), F.expr("nullif(l_suppkey, 5) as utid")),
        "spurious_sched_wakeup": c.select(trace("c_custkey"), F.col("c_custkey").alias("id"), F.expr("c_custkey * 70000000000 - 5000000000000 as ts"), F.expr("if(c_nationkey = 2, null, c_custkey * 3) as utid"), F.expr("if(c_nationkey > 9, c_custkey + 2, null) as waker_utid")),
        "instant": u.select(trace("s_suppkey"), F.expr("s_suppkey * 1000000000000 as ts"), F.col("s_nationkey").alias("track_id"), F.expr("if(s_suppkey % 4 = 1, null, s_name) as name")),
        "thread": c.select(trace("c_custkey"), F.col("c_custkey").alias("utid"), F.col("c_name").alias("name")),
        "process": n.select(trace("n_nationkey"), F.col("n_nationkey").alias("upid"), F.col("n_name").alias("name")),
        "clock_snapshot": n.select(F.expr("cast(n_nationkey % 2 as string) as trace"), F.expr("n_nationkey * 10000000000000 as ts"), F.lit("REALTIME").alias("clock_name"), F.expr("694224000000000000 + n_nationkey * 10000000777000 as clock_value")),
        "args": p.select(trace("p_partkey div 5"), F.expr("p_partkey div 5 as arg_set_id"), F.expr("concat('arg.', p_partkey % 5) as flat_key"), F.expr("if(p_partkey % 3 = 0, p_brand, null) as string_value"), F.expr("if(p_partkey % 3 = 1, p_size, null) as int_value"), F.expr("if(p_partkey % 3 = 2, p_retailprice, null) as real_value")),
    }


_US = lambda ns: f"CASE WHEN {ns} < 0 THEN 'running' ELSE printf('%.1f', {ns} / 1000.0::DOUBLE) || 'us' END"
_NOTES = lambda group, **values: "concat_ws(';', " + ", ".join(f"'perfetto.{group}.{k}=' || ({v})::VARCHAR" for k, v in values.items()) + ")"
TRACE_TABLES = f"""{SPANS},
slice AS (SELECT (trace_id % 3)::VARCHAR AS trace, trace_id * 8 + span_id AS id, (start_ns - 694224000000000000) // 1000 AS ts, (end_ns - start_ns) // 86400000000000 * 1050 + trace_id * 25 - 100 AS dur, CASE WHEN span_id <> 2 THEN name END AS name, CASE WHEN span_id <> 0 THEN trace_id * 8 END AS parent_id, trace_id % 7 AS track_id, CASE WHEN span_id = 0 THEN 0 ELSE 1 END AS depth FROM spans),
clock AS (SELECT (n_nationkey % 2)::VARCHAR AS trace, n_nationkey::BIGINT * 10000000000000 AS ts, 694224000000000000 + n_nationkey::BIGINT * 10000000777000 AS unix FROM nation),
kinds AS (
  SELECT trace, 'slice' AS kind, 0 AS kind_no, id, ts, coalesce(name, '(unnamed)') || '  dur=' || {_US("dur")} || '  depth=' || depth AS body, {_NOTES("slice", id="id", name="coalesce(name, '(unnamed)')", dur_ns="dur", depth="depth")} AS attrs FROM slice
  UNION ALL SELECT (event_id % 3)::VARCHAR, 'sched_slice', 1, event_id, event_id * 100000000000, 'cpu=' || (user_id % 4) || ' state=' || st || ' utid=' || user_id || '  dur=' || {_US("event_id * 150")}, {_NOTES("sched", id="event_id", cpu="user_id % 4", dur_ns="event_id * 150", end_state="st")} FROM (SELECT *, CASE WHEN event_type = 'signup' THEN '?' ELSE event_type END AS st FROM events)
  UNION ALL SELECT (o_orderkey % 3)::VARCHAR, 'thread_state', 2, o_orderkey, o_orderkey * 20000000000, 'state=' || st || ' dur=' || {_US("o_custkey * 10")} || ' utid=' || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN ' cpu=' || (o_custkey % 4) ELSE '' END || CASE WHEN o_orderkey % 5 = 1 THEN ' io_wait' ELSE '' END || CASE WHEN o_orderkey % 4 = 0 THEN ' blocked=' || o_orderpriority ELSE '' END || CASE WHEN o_orderkey % 7 = 0 THEN ' waker=' || (o_custkey + 1) ELSE '' END,
    {_NOTES("ts", id="o_orderkey", state="st", dur_ns="o_custkey * 10", utid="o_custkey", cpu="CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 4 END", io_wait="CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 END", blocked_function="CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END")} FROM (SELECT *, CASE WHEN o_orderstatus = 'P' THEN '?' ELSE o_orderstatus END AS st FROM orders)
  UNION ALL SELECT (l_orderkey % 3)::VARCHAR, 'ftrace_event', 3, l_orderkey * 8 + l_linenumber, l_partkey * 100000000000, nm || ' cpu=' || cpu, {_NOTES("ftrace", id="l_orderkey * 8 + l_linenumber", name="nm", cpu="cpu", utid="nullif(l_suppkey, 5)")} FROM (SELECT *, CASE WHEN l_returnflag = 'A' THEN '?' ELSE l_returnflag END AS nm, CASE WHEN l_linenumber = 3 THEN -1 ELSE l_suppkey % 4 END AS cpu FROM lineitem)
  UNION ALL SELECT (c_custkey % 3)::VARCHAR, 'spurious_sched_wakeup', 4, c_custkey, c_custkey * 70000000000 - 5000000000000, 'spurious_wakeup utid=' || CASE WHEN c_nationkey = 2 THEN -1 ELSE c_custkey * 3 END, {_NOTES("sw", id="c_custkey", utid="CASE WHEN c_nationkey <> 2 THEN c_custkey * 3 END", waker_utid="CASE WHEN c_nationkey > 9 THEN c_custkey + 2 END")} FROM customer
  UNION ALL SELECT (s_suppkey % 3)::VARCHAR, 'instant', 5, NULL, s_suppkey * 1000000000000, nm, {_NOTES("instant", name="nm", track_id="s_nationkey")} FROM (SELECT *, CASE WHEN s_suppkey % 4 = 1 THEN '?' ELSE s_name END AS nm FROM supplier)),
timed AS (SELECT r.*, greatest(0, CASE WHEN a.ts IS NULL AND b.ts IS NULL THEN 0 WHEN a.ts IS NULL THEN b.unix - (b.ts - r.ts) WHEN b.ts IS NULL THEN a.unix + (r.ts - a.ts) ELSE a.unix + ((r.ts - a.ts)::HUGEINT * (b.unix - a.unix) // (b.ts - a.ts))::BIGINT END) AS unix_ns
  FROM kinds r ASOF LEFT JOIN clock a ON r.trace = a.trace AND r.ts >= a.ts ASOF LEFT JOIN clock b ON r.trace = b.trace AND r.ts < b.ts)"""


def metrics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of metrics in JSON for each order: a plain number, a gauge with label and unit, and a gauge within."""
    o = table(spark, sf_dir, "orders")
    owner = F.expr("named_struct('value', o_custkey, 'segment', o_orderstatus) as owner")
    price = F.struct(F.col("o_totalprice").alias("value"), F.lit("usd").alias("unit"), F.lit("total").alias("description"), F.col("o_orderpriority").alias("priority"), owner)
    return o.select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("count"), price.alias("price"), F.lit("none").alias("note"))).alias("metrics"))
