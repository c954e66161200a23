"""Queries over the test tables, one for each operator, with SQL for the same rows where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybrook.functions import attributes, severity, text
from tallybrook.operators import conditions, dedup, discover, emission, ordering, parsers, predicates, retention, summary, templates, traces
from tallybrook.plans.adapter import LINES, LOGS, SEGMENTS, SPANS, TRACE_TABLES, lines, log_requests, logs, metrics_json, segments, span_requests, spans, table, trace_tables
from tallybrook.sources import otlp, record_info, rendering
from tallybrook.sources import trace_tables as traced

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, with_: str = LOGS):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = (f"WITH {with_} " if with_ else "") + sql
        return f

    return add


KEYS = ("seq", "ts_ns", "severity_text", "service_name", "body")
K = ", ".join(KEYS)

# ---- predicates ----


@query("f1_type_eq", f"SELECT {K} FROM logs WHERE event_type = 'error'")
def f1(s, d):
    return logs(s, d).filter(predicates.record_type("error", "event_type")).select(*KEYS)


@query("f2_seq_range", f"SELECT {K} FROM logs WHERE seq BETWEEN 100 AND 900")
def f2(s, d):
    return logs(s, d).filter(predicates.between("seq", 100, 900)).select(*KEYS)


@query("f3_ts_range", f"SELECT {K} FROM logs WHERE ts_ns >= 1704067200000000000 + 86400000000000 AND ts_ns <= 1704067200000000000 + 20 * 86400000000000")
def f3(s, d):
    start = 1704067200000000000
    return logs(s, d).filter(predicates.between("ts_ns", start + 86400 * 10**9, start + 20 * 86400 * 10**9)).select(*KEYS)


@query("f4_literal_and", f"SELECT {K} FROM logs WHERE contains(body, 'error') AND contains(body, 'k=1')")
def f4(s, d):
    return logs(s, d).filter(predicates.literals("body", ["error", "k=1"])).select(*KEYS)


@query("f5_regex_and", f"SELECT {K} FROM logs WHERE regexp_matches(body, 'user=[0-9]*7 ') AND regexp_matches(body, 'click|view')")
def f5(s, d):
    return logs(s, d).filter(predicates.patterns("body", ["user=[0-9]*7 ", "click|view"])).select(*KEYS)


@query("f6_ignore_case", f"SELECT {K} FROM logs WHERE contains(lower(body), 'error') AND regexp_matches(body, '(?i)USER=1')")
def f6(s, d):
    return logs(s, d).filter(predicates.literals("body", ["ERROR"], True) & predicates.patterns("body", ["USER=1"], True)).select(*KEYS)


@query("f7_any_of_batch", "SELECT batch, count(*) AS events, count(*) FILTER (severity_number >= 17 AND k > 50) AS matching FROM logs GROUP BY batch HAVING matching > 0")
def f7(s, d):
    return predicates.any_of_batch(logs(s, d), "batch", (F.col("severity_number") >= 17) & (F.col("k") > 50))


@query("f8_batch_no_offender", f"SELECT {K} FROM logs WHERE batch NOT IN (SELECT batch FROM logs WHERE severity_text NOT IN ('DEBUG', 'TRACE', 'WARN', 'INFO'))")
def f8(s, d):
    return predicates.no_offender(logs(s, d), "batch", severities=("DEBUG", "TRACE", "WARN", "INFO")).select(*KEYS)


@query("f9_event_sets", f"SELECT {K} FROM logs WHERE service_name IN ('svc-1', 'svc-3') AND severity_text IN ('ERROR', 'WARN')")
def f9(s, d):
    return logs(s, d).filter(predicates.in_sets(("svc-1", "svc-3"), ("ERROR", "WARN"))).select(*KEYS)


@query("f12_after_cursor", f"SELECT {K} FROM logs WHERE seq > 950")
def f12(s, d):
    return logs(s, d).filter(F.col("seq") > 950).select(*KEYS)


# ---- conditions ----


@query("c4_unset_is_nomatch", f"SELECT {K} FROM (SELECT *, CASE WHEN k % 3 <> 0 THEN k END AS kk FROM logs) WHERE coalesce(NOT (kk < 50), false)")
def c4(s, d):
    rows = logs(s, d).withColumn("kk", F.when(F.col("k") % 3 != 0, F.col("k")))
    return rows.filter(predicates.holds(~(F.col("kk") < 50))).select(*KEYS)


def signals(s, d):
    """Log events, their values as gauges, and orders and lines as spans, as wide event rows."""
    from tallybrook.plans.model import wide

    attributes = F.to_json(F.struct(F.col("k").cast("string").alias("k"), F.col("user_id").cast("string").alias("user")))
    log = logs(s, d).select(F.col("seq").alias("sequence"), F.col("ts_ns").alias("timestamp_unix_ns"), F.lit("logs").alias("signal_type"), "severity_number", "severity_text", F.col("body").alias("body_string"), "service_name", attributes.alias("log_attributes_json"))
    metric = logs(s, d).select(F.col("seq").alias("sequence"), F.col("ts_ns").alias("timestamp_unix_ns"), F.lit("metrics").alias("signal_type"), F.concat(F.lit("event."), "event_type").alias("metric_name"), F.lit("Gauge").alias("metric_type"), F.col("value").alias("metric_value_number"), "service_name")
    span = spans(s, d).select(F.col("trace_id").alias("sequence"), F.col("start_ns").alias("timestamp_unix_ns"), F.lit("traces").alias("signal_type"), F.col("trace_id").cast("string").alias("trace_id"), F.col("span_id").cast("string").alias("span_id"), F.col("parent_span_id").cast("string").alias("parent_span_id"), F.col("name").alias("span_name"), F.when(F.col("parent_span_id").isNull(), "Server").otherwise("Client").alias("span_kind"), F.col("start_ns").alias("start_time_unix_ns"), F.col("end_ns").alias("end_time_unix_ns"), (F.col("end_ns") - F.col("start_ns")).alias("duration_ns"))
    return wide(log).unionByName(wide(metric)).unionByName(wide(span))


@query("c1_logs_condition", "SELECT seq AS sequence FROM logs WHERE severity_number >= 9 AND body LIKE '%user=%' AND (k = 3 OR user_id % 10 = 7)")
def c1(s, d):
    return conditions.matching(signals(s, d), "logs", lambda v: (v.severity_number >= 9) & v.body.contains("user=") & ((v.attributes["k"] == "3") | v.attributes["user"].endswith("7"))).select("sequence")


@query("c2_metrics_condition", "SELECT seq AS sequence FROM logs WHERE event_type IN ('click', 'view') AND value > 50 AND service_name <> 'svc-2'")
def c2(s, d):
    return conditions.matching(signals(s, d), "metrics", lambda v: v.metric_name.isin("event.click", "event.view") & (v.value > 50) & (v.service_name != "svc-2") & (v.count == 0)).select("sequence")


@query("c3_spans_condition", "SELECT trace_id AS sequence, span_id::VARCHAR AS span_id FROM spans WHERE parent_span_id IS NOT NULL AND name = 'ship R' AND end_ns - start_ns > 5000000000000000", SPANS)
def c3(s, d):
    return conditions.matching(signals(s, d), "traces", lambda v: (v.kind == 3) & (v.name == "ship R") & (v.duration_ns > 5_000_000_000_000_000) & ~v.parent_span_id.isNull()).select("sequence", "span_id")


@query("c5_scalar_bool", f"SELECT {K} FROM logs WHERE (severity_number >= 13 AND k <> 5 OR service_name = 'svc-0') AND NOT (seq < 1_00)")
def c5(s, d):
    c = ((F.col("severity_number") >= 13) & (F.col("k") != 5) | (F.col("service_name") == "svc-0")) & ~(F.col("seq") < 100)
    return logs(s, d).filter(predicates.holds(c)).select(*KEYS)


@query("c6_string_methods", f"SELECT {K} FROM logs WHERE contains(body, 'user=1') AND starts_with(body, 'click') AND ends_with(body, '7')")
def c6(s, d):
    b = F.col("body")
    return logs(s, d).filter(b.contains("user=1") & b.startswith("click") & b.endswith("7")).select(*KEYS)


@query("c7_matches", f"SELECT {K} FROM logs WHERE regexp_matches(body, 'k=[0-9]$')")
def c7(s, d):
    return logs(s, d).filter(F.col("body").rlike("k=[0-9]$")).select(*KEYS)


@query("c8_size", "SELECT seq, length(body)::INT AS body_size, len(string_split(body, ' '))::INT AS words FROM logs WHERE length(body) > 18")
def c8(s, d):
    return logs(s, d).filter(F.length("body") > 18).select("seq", F.length("body").alias("body_size"), F.size(F.split("body", " ")).alias("words"))


@query("c9_exists", "SELECT batch FROM logs GROUP BY batch HAVING bool_or(k > 95)")
def c9(s, d):
    return logs(s, d).groupBy("batch").agg(F.bool_or(F.col("k") > 95).alias("any")).filter("any").select("batch")


@query("c10_has", f"SELECT {K} FROM logs WHERE k % 2 = 0")
def c10(s, d):
    m = F.map_from_arrays(F.filter(F.array(F.lit("user"), F.when(F.col("k") % 2 == 0, F.lit("k"))), lambda x: x.isNotNull()), F.filter(F.array(F.col("user_id"), F.when(F.col("k") % 2 == 0, F.col("k").cast("long"))), lambda x: x.isNotNull()))
    return logs(s, d).filter("user_id is not null").filter(F.map_contains_key(m, "k")).select(*KEYS)


@query("c11_map_index", "SELECT seq, k, user_id % 7 AS seventh FROM logs WHERE k = 42")
def c11(s, d):
    m = F.create_map(F.lit("k"), F.col("k").cast("long"), F.lit("seventh"), F.col("user_id") % 7)
    return logs(s, d).filter(F.try_element_at(m, F.lit("k")) == 42).select("seq", "k", F.try_element_at(m, F.lit("seventh")).alias("seventh"))


# ---- aggregations ----


@query("a1_count", "SELECT count(*) AS n FROM logs WHERE severity_number >= 13")
def a1(s, d):
    return logs(s, d).filter("severity_number >= 13").agg(F.count(F.lit(1)).alias("n"))


@query("a2_file_summary", "SELECT file, count(*) AS records_scanned, count(*) FILTER (k = 99 AND severity_number = 17) AS records_matched, min(ts_ns) FILTER (k = 99 AND severity_number = 17) AS first_ts, max(ts_ns) FILTER (k = 99 AND severity_number = 17) AS last_ts FROM logs GROUP BY file")
def a2(s, d):
    return summary.file_summary(logs(s, d), (F.col("k") == 99) & (F.col("severity_number") == 17))


@query("a3_by_service", "SELECT service_name AS value, count(*) AS n FROM logs WHERE service_name IS NOT NULL GROUP BY 1")
def a3(s, d):
    return summary.count_by(logs(s, d), "service_name")


@query("a4_by_severity", "SELECT coalesce(CASE WHEN k % 4 <> 0 THEN severity_text END, '<unset>') AS value, count(*) AS n FROM logs GROUP BY 1")
def a4(s, d):
    return summary.count_by(logs(s, d).withColumn("severity_text", F.when(F.col("k") % 4 != 0, F.col("severity_text")).otherwise("")), "severity_text", "<unset>")


@query("a6_span", "SELECT min(ts_ns) AS first_ts, max(ts_ns) AS last_ts FROM logs")
def a6(s, d):
    return logs(s, d).agg(F.min("ts_ns").alias("first_ts"), F.max("ts_ns").alias("last_ts"))


@query("a7_top_services", "SELECT service_name AS value, count(*) AS n FROM logs WHERE ts_ns >= 1704067200000000000 AND regexp_matches(body, 'k=[0-9]*[02468]$') GROUP BY 1 ORDER BY n DESC, value LIMIT 3")
def a7(s, d):
    rows = logs(s, d).filter(predicates.between("ts_ns", 1704067200000000000) & predicates.patterns("body", ["k=[0-9]*[02468]$"]))
    return summary.top(summary.count_by(rows, "service_name"), 3)


@query("a8_all_severities", "SELECT severity_text AS value, count(*) AS n FROM logs GROUP BY 1 ORDER BY 1")
def a8(s, d):
    return summary.count_by(logs(s, d), "severity_text").orderBy("value")


_A9 = {"ts_min": 1704067200000000000 + 3 * 86400 * 10**9, "ts_max": 1704067200000000000 + 9 * 86400 * 10**9, "severities": ["ERROR", "WARN"]}
_A9_SQL = f"""x AS (SELECT *, seq // 3 AS block, ts_ns BETWEEN {_A9["ts_min"]} AND {_A9["ts_max"]} AND severity_text IN ('ERROR', 'WARN') AS hit FROM logs),
b AS (SELECT file, block, count(*) AS n, max(ts_ns) >= {_A9["ts_min"]} AND min(ts_ns) <= {_A9["ts_max"]} AND bool_or(severity_text IN ('ERROR', 'WARN')) AS may FROM x GROUP BY ALL),
f AS (SELECT file, coalesce(sum(n) FILTER (may), 0)::BIGINT AS records_scanned, NOT bool_or(may) AS skipped_by_index FROM b GROUP BY file),
m AS (SELECT file, count(*) FILTER (hit) AS n, min(ts_ns) FILTER (hit) AS first_ts, max(ts_ns) FILTER (hit) AS last_ts FROM x GROUP BY file)"""


@query(
    "a9_discover",
    """SELECT 'file' AS kind, file AS name, records_scanned, n AS records_matched, n AS log_events, first_ts, last_ts, skipped_by_index FROM f JOIN m USING (file)
    UNION ALL SELECT 'summary', '', sum(records_scanned)::BIGINT, sum(n)::BIGINT, sum(n)::BIGINT, min(first_ts), max(last_ts), NULL FROM f JOIN m USING (file)""",
    LOGS + ", " + _A9_SQL,
)
def a9(s, d):
    rows = logs(s, d).withColumn("block", F.floor(F.col("seq") / 3).cast("long"))
    index = discover.index_of(rows, "file", "block", "seq", "seq", "ts_ns", "service_name", "severity_text")
    event = F.array(F.struct(F.col("service_name").alias("service"), F.col("severity_text").alias("severity")))
    records = rows.select("file", F.col("block").alias("block_offset"), F.lit("logs").alias("record_type"), "seq", F.col("ts_ns").alias("ts_unix_ns"), event.alias("events"))
    files, _ = discover.discover(index, lambda places: records.join(places, ["file", "block_offset"], "left_semi"), **_A9)
    return discover.rows_of(files)


@query("a10_catalog", "SELECT DISTINCT 'service_name' AS kind, service_name AS value FROM logs WHERE service_name IS NOT NULL UNION SELECT DISTINCT 'severity_text', severity_text FROM logs WHERE severity_text IS NOT NULL")
def a10(s, d):
    return summary.catalogue(logs(s, d), "service_name", "severity_text")


@query("a11_bounded_distinct", "SELECT batch, count(DISTINCT user_id) AS n, count(DISTINCT user_id) <= 8 AS complete, CASE WHEN count(DISTINCT user_id) <= 8 THEN array_to_string(list_sort(list(DISTINCT user_id::VARCHAR)), ',') END AS \"values\" FROM logs WHERE user_id IS NOT NULL GROUP BY batch")
def a11(s, d):
    return summary.bounded_distinct(logs(s, d), "batch", "user_id", 8)


@query("a12_first_last", "SELECT file, arg_min(ts_ns, seq) AS first_ts_ns, arg_max(ts_ns, seq) AS last_ts_ns, min(seq) AS first_seq, max(seq) AS last_seq FROM logs GROUP BY file")
def a12(s, d):
    return summary.first_last(logs(s, d), "file", "seq", "ts_ns", "seq")


@query("a13_type_mask", "SELECT batch, bit_or(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 4 WHEN 'error' THEN 8 ELSE 0 END)::INT AS mask FROM logs GROUP BY batch")
def a13(s, d):
    kinds = F.create_map(*[F.lit(x) for kv in {"click": "logs", "view": "metrics", "purchase": "traces", "error": "events"}.items() for x in kv])
    return summary.type_mask(logs(s, d).withColumn("kind", F.try_element_at(kinds, F.col("event_type"))), "batch", "kind")


@query("a15_segments", "SELECT service_name, file, records, size, first_seq, last_seq FROM segments", SEGMENTS)
def a15(s, d):
    return segments(s, d)


@query("a16_rebatch", "SELECT service_name, severity_text, min(seq) AS first_pos, max(seq) AS last_pos, count(*) AS members FROM logs GROUP BY 1, 2")
def a16(s, d):
    return summary.regrouped(logs(s, d), "seq", "service_name", "severity_text")


@query("a19_batch_priority", "SELECT batch, max((severity_number - 1) // 4 + 1)::INT AS priority FROM logs GROUP BY batch")
def a19(s, d):
    return summary.batch_priority(logs(s, d), "batch")


@query("a22_kind_histogram", "SELECT name AS value, count(*) AS n FROM spans GROUP BY 1", SPANS)
def a22(s, d):
    return summary.count_by(spans(s, d), "name")


@query("u5_stats", "SELECT event_type, count(*) AS records, sum(strlen(body))::BIGINT AS bytes, min(ts_ns) AS first_ts, max(ts_ns) AS last_ts, min(strlen(body))::BIGINT AS min_bytes, max(strlen(body))::BIGINT AS max_bytes, round(avg(strlen(body)), 6) AS avg_bytes FROM logs GROUP BY event_type")
def u5(s, d):
    return summary.field_stats(logs(s, d), "event_type", F.octet_length("body"), "ts_ns")


# ---- projections ----


@query("p6_attr_precedence", "SELECT seq, body AS m_body, service_name AS m_service, (k + 1)::VARCHAR AS m_k, user_id::VARCHAR AS m_user_id FROM logs")
def p6(s, d):
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    fixed = F.array(pair("body", F.col("body")))
    resource = F.array(pair("service", F.col("service_name")), pair("k", F.col("k") + 1))
    record = F.array(pair("body", F.lit("shadowed")), pair("k", F.col("k")), pair("user.id", F.col("user_id")))
    m = attributes.flattened([fixed, resource, record])
    return logs(s, d).withColumn("m", m).select("seq", *[F.try_element_at("m", F.lit(x)).alias(f"m_{x}") for x in ("body", "service", "k", "user_id")])


@query("p10_fields", "SELECT seq, body FROM logs")
def p10(s, d):
    rows, wanted = logs(s, d), ["body", "nothing", "seq"]
    return rows.select(*[c for c in rows.columns if c in wanted])


@query("p11_preview", "SELECT seq, CASE WHEN strlen(body) > 14 THEN left(body, 14) || '...' ELSE body END AS preview FROM logs")
def p11(s, d):
    return logs(s, d).select("seq", text.preview(F.col("body"), 14).alias("preview"))


@query("p13_ts_text", "SELECT seq, strftime(ts, '%Y-%m-%d %H:%M:%S') || '.' || lpad((ts_ns % 1000000000)::VARCHAR, 9, '0') || ' UTC' AS at FROM logs".replace("AS at ", "AS at_text "))
def p13(s, d):
    return logs(s, d).select("seq", text.ns_text(F.col("ts_ns")).alias("at_text"))


@query("p14_syslog_time", "SELECT seq, strftime(ts, '%b ') || lpad(day(ts)::VARCHAR, 2, ' ') || strftime(ts, ' %H:%M:%S') AS at_text FROM logs")
def p14(s, d):
    return logs(s, d).select("seq", text.syslog_time(F.col("ts_ns")).alias("at_text"))


@query("p15_summary_line", "SELECT trace_id, string_agg(name || ' (' || CASE WHEN span_id = 0 THEN 'Server' ELSE 'Internal' END || ')', '; ' ORDER BY span_id, name) AS line FROM spans GROUP BY trace_id", SPANS)
def p15(s, d):
    piece = F.concat("name", F.lit(" ("), severity.span_kind(F.when(F.col("span_id") == 0, 2).otherwise(1)), F.lit(")"))
    rows = spans(s, d).groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("span_id", piece.alias("p")))).alias("ps"))
    return rows.select("trace_id", F.array_join("ps.p", "; ").alias("line"))


@query("p17_record_info", "SELECT batch, count(DISTINCT service_name) AS services, count(DISTINCT severity_text) AS severities, count(DISTINCT event_type) AS events FROM logs GROUP BY batch")
def p17(s, d):
    return logs(s, d).groupBy("batch").agg(F.count_distinct("service_name").alias("services"), F.count_distinct("severity_text").alias("severities"), F.count_distinct("event_type").alias("events"))


@query("p18_single_line", "SELECT doc_id, CASE WHEN length(f) > 160 THEN left(f, 160) || '...' ELSE f END AS line FROM (SELECT doc_id, regexp_replace(text, '[\\x00-\\x1f\\x7f]', ' ', 'g') AS f FROM documents)", "")
def p18(s, d):
    return table(s, d, "documents").select("doc_id", text.single_line(F.col("text")).alias("line"))


@query("p19_hex", "SELECT seq, lower(hex(encode(left(body, 8)))) AS hexed FROM logs")
def p19(s, d):
    return logs(s, d).select("seq", text.hex_preview(F.encode("body", "UTF-8"), 8).alias("hexed"))


@query("p20_duration", "SELECT trace_id, span_id, greatest(end_ns - start_ns, 0) AS duration_ns FROM spans", SPANS)
def p20(s, d):
    return spans(s, d).select("trace_id", "span_id", F.greatest(F.col("end_ns") - F.col("start_ns"), F.lit(0).cast("long")).alias("duration_ns"))


@query("p21_effective_ts", "SELECT seq, CASE WHEN k % 3 = 0 THEN ts_ns + 7 ELSE ts_ns END AS effective FROM logs")
def p21(s, d):
    rows = logs(s, d).withColumn("time", F.when(F.col("k") % 3 == 0, 0).otherwise(F.col("ts_ns")))
    return rows.select("seq", F.coalesce(F.nullif("time", F.lit(0)), F.col("ts_ns") + 7).alias("effective"))


@query("p22_event_time", "SELECT seq, greatest(ts_ns, ts_ns - 5 + k) AS event_ns FROM logs")
def p22(s, d):
    return logs(s, d).select("seq", F.greatest("ts_ns", F.col("ts_ns") - 5 + F.col("k")).alias("event_ns"))


@query("p23_sev_label", "SELECT k, CASE WHEN k BETWEEN 1 AND 4 THEN 'TRACE' WHEN k BETWEEN 5 AND 8 THEN 'DEBUG' WHEN k BETWEEN 9 AND 12 THEN 'INFO' WHEN k BETWEEN 13 AND 16 THEN 'WARN' WHEN k BETWEEN 17 AND 20 THEN 'ERROR' WHEN k BETWEEN 21 AND 24 THEN 'FATAL' END AS label, count(*) AS n FROM logs GROUP BY 1, 2")
def p23(s, d):
    return logs(s, d).groupBy("k", severity.label(F.col("k")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("p24_sev_label_client", "SELECT k, CASE WHEN k <= 4 THEN 'TRACE' WHEN k <= 8 THEN 'DEBUG' WHEN k <= 12 THEN 'INFO' WHEN k <= 16 THEN 'WARN' WHEN k <= 20 THEN 'ERROR' ELSE 'FATAL' END AS label, count(*) AS n FROM logs GROUP BY 1, 2")
def p24(s, d):
    return logs(s, d).groupBy("k", severity.label_clamped(F.col("k")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("p27_batch_ts", "SELECT batch, arg_min(ts_ns, seq) FILTER (k % 4 <> 0) AS batch_ts FROM logs GROUP BY batch")
def p27(s, d):
    t = F.when(F.col("k") % 4 != 0, F.col("ts_ns"))
    return logs(s, d).groupBy("batch").agg(F.min_by(t, F.when(t.isNotNull(), F.col("seq"))).alias("batch_ts"))


@query("p28_human_size", "SELECT k, k * 1000000 AS mb, k * 1048576 AS mib, k * 1024 AS plain FROM (SELECT DISTINCT k::BIGINT AS k FROM logs)")
def p28(s, d):
    size = lambda unit: text.human_size(F.concat(F.col("k").cast("string"), F.lit(unit)))
    return logs(s, d).select(F.col("k").cast("long").alias("k")).distinct().select("k", size("mb").alias("mb"), size("MiB").alias("mib"), size("").alias("plain"))


@query("w4_ndjson", "SELECT seq, to_json({'body': body, 'service_name': service_name, 'k': k}) AS line FROM logs")
def w4(s, d):
    return logs(s, d).select("seq", F.to_json(F.struct("body", "service_name", "k")).alias("line"))


@query("w5_wide37", "SELECT seq AS sequence, ts_ns AS timestamp_unix_ns, 'logs' AS signal_type, severity_number, severity_text, 'string' AS body_kind, body AS body_string, service_name FROM logs UNION ALL SELECT seq, ts_ns, 'metrics', NULL, NULL, NULL, NULL, service_name FROM logs")
def w5(s, d):
    from tallybrook.plans.model import wide

    log = logs(s, d).select(F.col("seq").alias("sequence"), F.col("ts_ns").alias("timestamp_unix_ns"), F.lit("logs").alias("signal_type"), "severity_number", "severity_text", F.lit("string").alias("body_kind"), F.col("body").alias("body_string"), "service_name")
    metric = logs(s, d).select(F.col("seq").alias("sequence"), F.col("ts_ns").alias("timestamp_unix_ns"), F.lit("metrics").alias("signal_type"), F.concat(F.lit("event."), "event_type").alias("metric_name"), F.lit("Gauge").alias("metric_type"), F.col("value").alias("metric_value_number"), "service_name")
    return wide(log).unionByName(wide(metric)).select("sequence", "timestamp_unix_ns", "signal_type", "severity_number", "severity_text", "body_kind", "body_string", "service_name")


# ---- order, paging, split ----


@query("o3_topk", "SELECT user_id::VARCHAR AS value, count(*) AS n FROM logs WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def o3(s, d):
    return summary.top(summary.count_by(logs(s, d).withColumn("user_id", F.col("user_id").cast("string")), "user_id"), 10)


@query("s9_page", "SELECT file, CASE WHEN (SELECT count(DISTINCT file) FROM logs) > 15 THEN 15 END AS next_offset FROM (SELECT DISTINCT file FROM logs) ORDER BY file LIMIT 10 OFFSET 5")
def s9(s, d):
    return ordering.page(logs(s, d).select("file").distinct(), "file", 5, 10)


@query("s11_concat", "SELECT seq, file, row_number() OVER (PARTITION BY file ORDER BY seq) AS row_no FROM logs")
def s11(s, d):
    return ordering.numbered(logs(s, d).select("seq", "file"), ["seq"], "file").withColumn("row_no", F.col("row_no").cast("long")).orderBy("file", "seq")


def _merge_sql(keys: str) -> str:
    first, second = keys.split(", ")
    lead = f"max({first}) OVER (PARTITION BY service_name ORDER BY seq ROWS UNBOUNDED PRECEDING)"
    return f"SELECT seq, service_name, {lead} AS lead FROM logs".replace("AS lead", "AS lead_key")


@query("s12_merge_seq", _merge_sql("seq, ts_ns"))
def s12(s, d):
    return ordering.merged(logs(s, d), "service_name", "seq", "seq", "ts_ns").select("seq", "service_name", F.col("merge_key.seq").alias("lead_key"))


@query("s13_merge_ts", _merge_sql("ts_ns, seq"))
def s13(s, d):
    return ordering.merged(logs(s, d), "service_name", "seq", "ts_ns", "seq").select("seq", "service_name", F.col("merge_key.ts_ns").alias("lead_key"))


@query("w9_row_range", "SELECT seq, row_no FROM (SELECT seq, row_number() OVER (ORDER BY seq) AS row_no FROM logs) WHERE row_no BETWEEN 11 AND 300")
def w9(s, d):
    return ordering.row_range(logs(s, d).select("seq"), ["seq"], 11, 300).select("seq", F.col("row_no").cast("long").alias("row_no"))


@query("o6_resequence", "SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS new_seq FROM logs WHERE k > 50")
def o6(s, d):
    return ordering.numbered(logs(s, d).filter("k > 50").select("seq"), ["seq"]).select("seq", (F.col("row_no") - 1).cast("long").alias("new_seq"))


@query("u4_split_records", "SELECT seq, (row_number() OVER (ORDER BY seq) - 1) // 100 AS part FROM logs")
def u4(s, d):
    return ordering.split_by_records(logs(s, d).select("seq"), ["seq"], 100).select("seq", "part")


@query("u4_split_bytes", "SELECT seq, coalesce(sum(strlen(body)) OVER (PARTITION BY service_name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 1000 AS part FROM logs")
def u4b(s, d):
    return ordering.split_by_bytes(logs(s, d), ["seq"], F.octet_length("body"), 1000, "service_name").select("seq", "part")


@query("u1_union", "SELECT 'logs' AS kind, count(*) AS n FROM logs WHERE k < 50 UNION ALL SELECT 'rest', count(*) FROM logs WHERE k >= 50")
def u1(s, d):
    rows = logs(s, d)
    return rows.filter("k < 50").select(F.lit("logs").alias("kind")).unionByName(rows.filter("k >= 50").select(F.lit("rest").alias("kind"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("j1_continuity", 'SELECT service_name, "after", seq AS "before", seq - "after" - 1 AS missing FROM (SELECT service_name, seq, lag(seq) OVER (PARTITION BY service_name ORDER BY seq) AS "after" FROM logs) WHERE seq - "after" > 1')
def j1(s, d):
    return ordering.continuity(logs(s, d), "service_name", "seq")


# ---- dedup ----


@query("d3_exact", "SELECT event_type, k, count(*) AS n, min(ts_ns) AS first_seen, max(ts_ns) AS last_seen, arg_min(body, seq) AS representative, min(seq) AS first_pos FROM logs GROUP BY 1, 2")
def d3(s, d):
    return dedup.groups(logs(s, d), ["event_type", "k"], "seq", "ts_ns", "body")


_SHAPE = "CASE WHEN len(regexp_extract_all(line, '\\b\\w+=\\S+')) >= 2 THEN 'kv' ELSE 'freetext' END"


@query("d4_shape_kv", f"SELECT shape, count(*) AS n FROM (SELECT {_SHAPE} AS shape FROM (SELECT body AS line FROM logs UNION ALL SELECT event_type || ' after ' || k::VARCHAR FROM logs)) GROUP BY 1")
def d4(s, d):
    rows = logs(s, d).select("body").unionByName(logs(s, d).select(F.concat_ws(" ", "event_type", F.lit("after"), F.col("k").cast("string")).alias("body")))
    return rows.groupBy(dedup.shape("body").alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@query("d5_canon_freetext", "SELECT seq, regexp_replace(body, '[0-9]{3,}', '_N_', 'g') AS canonical FROM logs")
def d5(s, d):
    return logs(s, d).select("seq", dedup.freetext("body").alias("canonical"))


@query("d6_tokens", "SELECT seq, event_type || ' ' || CASE k % 4 WHEN 0 THEN '_UUID_' WHEN 1 THEN '_IPV4_' WHEN 2 THEN '_TS_' ELSE '_PATH_' END || ', _HEX_ ' || CASE WHEN length(seq::VARCHAR) >= 3 THEN '_N_' ELSE seq::VARCHAR END || ' _F_' AS canonical FROM logs")
def d6(s, d):
    token = F.when(F.col("k") % 4 == 0, "00c0ffee-1234-5678-9abc-def012345678").when(F.col("k") % 4 == 1, F.concat(F.lit("10.0.2."), F.col("k").cast("string"))).when(F.col("k") % 4 == 2, "2024-01-02T03:04:05Z").otherwise("/var/log/x")
    body = F.concat(F.col("event_type"), F.lit("  "), token, F.lit(", 0xBEEF "), F.col("seq").cast("string"), F.lit(" 1.25"))
    return logs(s, d).withColumn("b", body).select("seq", dedup.freetext("b").alias("canonical"))


@query("d8_canon_kv", "SELECT seq, 'count=_N_ user=' || CASE WHEN length(user_id::VARCHAR) >= 3 THEN '_N_' ELSE user_id::VARCHAR END || ' load=_F_' AS canonical FROM logs WHERE user_id IS NOT NULL")
def d8(s, d):
    body = F.concat(F.lit("count="), F.col("k").cast("string"), F.lit(" user="), F.col("user_id").cast("string"), F.lit(" load=0.5"))
    return logs(s, d).filter("user_id is not null").withColumn("b", body).select("seq", dedup.key_value("b").alias("canonical"))


@query("d10_prefixed", "SELECT seq, 'route ' || event_type || ' done' AS canonical FROM logs")
def d10(s, d):
    body = F.concat(F.lit("[12:34:5] nav.cpp:465: route "), F.col("event_type"), F.lit(" done"))
    return logs(s, d).withColumn("b", body).select("seq", dedup.canonical("b").alias("canonical"))


@query("d11_canon_groups", "SELECT canonical, count(*) AS n, min(ts_ns) AS first_seen, max(ts_ns) AS last_seen, arg_min(body, seq) AS representative, min(seq) AS first_pos FROM (SELECT *, regexp_replace(body, '[0-9]{3,}', '_N_', 'g') AS canonical FROM logs) GROUP BY 1")
def d11(s, d):
    exact = dedup.groups(logs(s, d), ["body"], "seq", "ts_ns", "body").withColumn("canonical", dedup.freetext("body"))
    return dedup.merged_groups(exact, ["canonical"])


@query("a18_reduction", "SELECT count(*) AS \"groups\", sum(n)::BIGINT AS events, round((1 - count(*) / sum(n)) * 100, 1) AS reduction_pct FROM (SELECT body, count(*) AS n FROM logs GROUP BY 1)")
def a18(s, d):
    return dedup.reduction(dedup.groups(logs(s, d), ["body"], "seq", "ts_ns", "body"))


_RUNS = "SELECT service_name, run, {key}, count(*) AS n, min(ts_ns) AS first_seen, max(ts_ns) AS last_seen, arg_min(body, seq) AS representative, min(seq) AS first_pos FROM (SELECT *, sum(new) OVER (PARTITION BY service_name ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM (SELECT *, CASE WHEN {key} IS DISTINCT FROM lag({key}) OVER (PARTITION BY service_name ORDER BY seq) THEN 1 ELSE 0 END AS new FROM (SELECT *, regexp_replace(body, '[0-9]{{3,}}', '_N_', 'g') AS canonical FROM logs))) GROUP BY ALL"


@query("d15_collapse_exact", _RUNS.format(key="event_type"))
def d15(s, d):
    return dedup.collapse(logs(s, d), "service_name", "seq", ["event_type"], "ts_ns", "body")


@query("d15_collapse_canon", _RUNS.format(key="canonical"))
def d15c(s, d):
    return dedup.collapse(logs(s, d).withColumn("canonical", dedup.freetext("body")), "service_name", "seq", ["canonical"], "ts_ns", "body")


_PAIRS = "SELECT seq, string_split(body, ' ') AS a, string_split(lag(body) OVER (PARTITION BY service_name ORDER BY seq), ' ') AS b FROM logs"


@query("d13_similarity", f"SELECT seq, len(list_filter(range(1, len(a) + 1), lambda i: a[i] = b[i])) / len(a) AS similar FROM ({_PAIRS}) WHERE b IS NOT NULL")
def d13(s, d):
    return _pairs(s, d).select("seq", dedup.similarity("a", "b").alias("similar"))


@query("d14_template", f"SELECT seq, array_to_string(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN a[i] = b[i] THEN a[i] ELSE '<*>' END), ' ') AS template FROM ({_PAIRS}) WHERE b IS NOT NULL")
def d14(s, d):
    return _pairs(s, d).select("seq", F.array_join(dedup.template("a", "b"), " ").alias("template"))


def _pairs(s, d):
    previous = F.lag("body").over(Window.partitionBy("service_name").orderBy("seq"))
    return logs(s, d).withColumn("p", previous).filter("p is not null").select("seq", F.split("body", " ").alias("a"), F.split("p", " ").alias("b"))


@query("d7_compound", "SELECT seq, 'Fake(_HEX_) x' || CASE WHEN seq >= 100 THEN '_N_' ELSE seq::VARCHAR END || '_c0 id__HEX_ F_N_' AS canonical FROM logs")
def d7(s, d):
    body = F.concat(F.lit("Fake(c1234abc) x"), F.col("seq").cast("string"), F.lit("_c0 id_deadbeef00 F0110"))
    return logs(s, d).withColumn("b", body).select("seq", dedup.freetext("b").alias("canonical"))


@query("d9_canon_json", "SELECT event_id, '{\"k\":' || CASE WHEN abs((props->>'$.k')::INT) >= 1000 THEN 0 ELSE (props->>'$.k')::INT END || '}' AS canonical FROM events", "")
def d9(s, d):
    return table(s, d, "events").select("event_id", dedup.json_text("props").alias("canonical"))


@query("d12_drain")
def d12(s, d):
    return templates.mined(logs(s, d), "seq", "body", 0.3)


@query("d_full_distinct")
def d_full(s, d):
    return dedup.distinct_full(logs(s, d), "seq", "ts_ns", "body", 0.6)


@query("d17_signature", "SELECT event_type, k, md5(arg_min(body, seq)) AS signature FROM logs GROUP BY 1, 2")
def d17(s, d):
    return dedup.groups(logs(s, d), ["event_type", "k"], "seq", "ts_ns", "body").select("event_type", "k", F.md5("representative").alias("signature"))


@query("d_lines_exact", "SELECT line, count(*) AS n, min(doc_id * 100000 + line_no) AS first_pos FROM lines WHERE line <> '' GROUP BY line HAVING count(*) > 1", LINES)
def dlines(s, d):
    rows = lines(s, d).filter("line <> ''").withColumn("pos", F.col("doc_id") * 100000 + F.col("line_no"))
    return rows.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos")).filter("n > 1")


# ---- overload and retention ----


@query("t1_rate_limit", "SELECT seq, CASE WHEN n <= 2 THEN 'accepted' WHEN severity_number >= 17 THEN 'bypass' ELSE 'rejected' END AS decision FROM (SELECT *, row_number() OVER (PARTITION BY service_name, file ORDER BY seq) AS n FROM logs)")
def t1(s, d):
    return retention.rate_limited(logs(s, d), "service_name", F.col("file"), ["seq"], 2, F.col("severity_number"), 17).select("seq", "decision")


@query("a20_overload", "SELECT service_name, count(*) FILTER (n <= 2) AS accepted, count(*) FILTER (n > 2 AND severity_number >= 17) AS bypass, count(*) FILTER (n > 2 AND severity_number < 17) AS rejected FROM (SELECT *, row_number() OVER (PARTITION BY service_name, file ORDER BY seq) AS n FROM logs) GROUP BY 1")
def a20(s, d):
    rows = retention.rate_limited(logs(s, d), "service_name", F.col("file"), ["seq"], 2, F.col("severity_number"), 17)
    return rows.groupBy("service_name").agg(*[F.count_if(F.col("decision") == x).alias(x) for x in ("accepted", "bypass", "rejected")])


@query("t2_oversize", "SELECT seq, strlen(body) > 18 AS oversize FROM logs")
def t2(s, d):
    return retention.oversize(logs(s, d), F.octet_length("body"), 18).select("seq", "oversize")


@query("t4_ring", "SELECT service_name, seq FROM (SELECT *, row_number() OVER (PARTITION BY service_name ORDER BY seq) AS a, row_number() OVER (PARTITION BY service_name ORDER BY seq DESC) AS z FROM logs) WHERE a <= 5 OR z <= 20")
def t4(s, d):
    return retention.ring(logs(s, d), "service_name", "seq", 5, 20).select("service_name", "seq")


@query("t4_ring_bytes", "SELECT service_name, seq FROM (SELECT *, sum(z) FILTER (a > 5) OVER (PARTITION BY service_name ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS newer, sum(z) FILTER (a <= 5) OVER (PARTITION BY service_name) AS head FROM (SELECT *, strlen(body) + 21 AS z, row_number() OVER (PARTITION BY service_name ORDER BY seq) AS a FROM logs)) WHERE a <= 5 OR head + newer <= 2000")
def t4b(s, d):
    return retention.ring_by_bytes(logs(s, d), "service_name", "seq", F.octet_length("body") + 21, 5, 2000).select("service_name", "seq")


_KEPT = "SELECT service_name, file, {kept} AS kept FROM segments"
_NEWEST = "OVER (PARTITION BY service_name ORDER BY file DESC ROWS {})"


@query("t5_retention", _KEPT.format(kept=f"sum(size) {_NEWEST.format('UNBOUNDED PRECEDING')} <= 9000 OR row_number() OVER (PARTITION BY service_name ORDER BY file DESC) = 1"), SEGMENTS)
def t5(s, d):
    return retention.retained(segments(s, d), "service_name", "file", "size", 9000).select("service_name", "file", "kept")


@query("t6_keep_bytes", _KEPT.format(kept=f"coalesce(sum(size) {_NEWEST.format('BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING')}, 0) < 9000"), SEGMENTS)
def t6(s, d):
    return retention.keep_bytes(segments(s, d), "service_name", "file", "size", 9000).select("service_name", "file", "kept")


@query("t6_keep_files", _KEPT.format(kept="row_number() OVER (PARTITION BY service_name ORDER BY file DESC) <= 3"), SEGMENTS)
def t6f(s, d):
    return retention.keep_files(segments(s, d), "service_name", "file", 3).select("service_name", "file", "kept")


@query("w12_rotation", "SELECT seq, coalesce(sum(strlen(body) + 21) OVER (PARTITION BY service_name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 4096 AS segment FROM logs")
def w12(s, d):
    return retention.rotated(logs(s, d), "service_name", ["seq"], F.octet_length("body") + 21, 4096).select("seq", "segment")


@query("t16_sequence", "SELECT seq, 1000 + row_number() OVER (ORDER BY seq) AS assigned FROM logs")
def t16(s, d):
    return ordering.numbered(logs(s, d).select("seq"), ["seq"]).select("seq", (F.col("row_no") + 1000).cast("long").alias("assigned"))


# ---- parsers ----


def _syslog(s, d):
    line = F.concat(F.lit("<"), (F.col("k") % 192).cast("string"), F.lit(">"), text.syslog_time(F.lit(1700000000000000000)), F.lit(" host"), (F.col("k") % 3).cast("string"), F.lit(" app: "), F.col("body"))
    return parsers.syslog(logs(s, d).select("seq", "k", F.col("body"), line.alias("value")))


@query("k2_syslog_pri", "SELECT seq, k % 192 AS pri, CASE WHEN k % 8 <= 2 THEN 'FATAL' WHEN k % 8 = 3 THEN 'ERROR' WHEN k % 8 = 4 THEN 'WARN' WHEN k % 8 <= 6 THEN 'INFO' ELSE 'DEBUG' END AS severity FROM logs")
def k2(s, d):
    return _syslog(s, d).select("seq", "pri", "severity")


@query("k4_facility", "SELECT (k // 8)::INT AS code, " + "[" + ", ".join(f"'{x}'" for x in parsers.FACILITIES) + "][k // 8 + 1] AS facility, count(*) AS n FROM logs GROUP BY 1, 2")
def k4(s, d):
    return _syslog(s, d).groupBy(F.shiftright("pri", 3).alias("code"), "facility").agg(F.count(F.lit(1)).alias("n"))


@query("k5_header", "SELECT seq, 'host' || (k % 3)::VARCHAR AS host, 'app' AS app, body AS message FROM logs")
def k5(s, d):
    return _syslog(s, d).select("seq", "host", "app", "message")


def _logcat(s, d):
    level = F.get(F.array(*map(F.lit, "VDIWE")), (F.col("k") % 5).cast("int"))
    line = F.when(F.col("k") % 2 == 0, F.concat(F.lit("06-11 22:14:15.123  1234  "), F.col("k").cast("string"), F.lit(" "), level, F.lit(" MyApp   : "), F.col("body"))).otherwise(F.concat(level, F.lit("/vm( "), F.col("k").cast("string"), F.lit("): "), F.col("body")))
    return parsers.logcat(logs(s, d).select("seq", "k", "body", line.alias("value")))


@query("k7_logcat", "SELECT seq, ['V', 'D', 'I', 'W', 'E'][k % 5 + 1] AS level, CASE WHEN k % 2 = 0 THEN 'MyApp' ELSE 'vm' END AS tag, CASE WHEN k % 2 = 0 THEN 1234 ELSE k END AS pid, CASE WHEN k % 2 = 0 THEN k END AS tid, body AS message FROM logs")
def k7(s, d):
    return _logcat(s, d).select("seq", "level", "tag", "pid", "tid", "message")


@query("k8_level", "SELECT ['TRACE', 'DEBUG', 'INFO', 'WARN', 'ERROR'][k % 5 + 1] AS severity, count(*) AS n FROM logs GROUP BY 1")
def k8(s, d):
    return _logcat(s, d).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query("k9_typed_attrs", "SELECT seq, CASE WHEN k % 2 = 0 THEN k ELSE 0 END::BIGINT AS int_value, 2 AS parts FROM logs")
def k9(s, d):
    value = F.when(F.col("k") % 2 == 0, F.col("k").cast("string")).otherwise("none")
    return logs(s, d).select("seq", parsers.typed(F.lit("int"), value)["int_value"].alias("int_value"), F.size(parsers.typed(F.lit("array"), F.lit("a,b"))["list_value"]).alias("parts"))


@query("k10_generator", "SELECT seq, ['TRACE', 'DEBUG', 'INFO', 'WARN', 'ERROR', 'FATAL'][seq % 6 + 1] AS severity_text, CASE WHEN seq % 100 = 0 THEN 2048 WHEN seq % 10 = 0 THEN 512 ELSE 64 END AS size, rpad('event ' || seq || ' ', CASE WHEN seq % 100 = 0 THEN 2048 WHEN seq % 10 = 0 THEN 512 ELSE 64 END, '.') AS body FROM (SELECT unnest(range(25000)) AS seq)", "")
def k10(s, d):
    return parsers.generated(s)


@query("k11_table_to_log", "SELECT trace_id, span_id, 'slice ' || name || ' dur=' || greatest(end_ns - start_ns, 0)::VARCHAR AS body FROM spans", SPANS)
def k11(s, d):
    return spans(s, d).select("trace_id", "span_id", F.concat(F.lit("slice "), "name", F.lit(" dur="), F.greatest(F.col("end_ns") - F.col("start_ns"), F.lit(0)).cast("string")).alias("body"))


@query("k12_span_batches", "SELECT trace_id, span_id, (row_number() OVER (PARTITION BY trace_id ORDER BY span_id) - 1) // 3 AS part FROM spans", SPANS)
def k12(s, d):
    n = F.row_number().over(Window.partitionBy("trace_id").orderBy("span_id"))
    return spans(s, d).select("trace_id", "span_id", F.floor((n - 1) / 3).cast("long").alias("part"))


@query(
    "k14_clock",
    """, c AS (SELECT service_name AS trace, seq AS ts, seq * 1000 + k AS unix FROM logs WHERE k % 10 = 0), r AS (SELECT service_name AS trace, seq AS ts FROM logs WHERE k % 10 <> 0),
j AS (SELECT r.*, (SELECT max(ts) FROM c WHERE c.trace = r.trace AND c.ts <= r.ts) AS t0, (SELECT min(ts) FROM c WHERE c.trace = r.trace AND c.ts >= r.ts) AS t1 FROM r)
SELECT j.trace, j.ts, CASE WHEN t0 IS NULL THEN b.unix - (t1 - j.ts) WHEN t1 IS NULL OR t0 = t1 THEN a.unix + (j.ts - t0) ELSE a.unix + ((j.ts - t0) * (b.unix - a.unix)) // (t1 - t0) END AS unix_ns
FROM j LEFT JOIN c a ON a.trace = j.trace AND a.ts = t0 LEFT JOIN c b ON b.trace = j.trace AND b.ts = t1""",
)
def k14(s, d):
    rows = logs(s, d).select(F.col("service_name").alias("trace"), F.col("seq").alias("ts"), "k")
    clock = rows.filter("k % 10 = 0").select("trace", "ts", (F.col("ts") * 1000 + F.col("k")).alias("unix"))
    return parsers.unix_ns(rows.filter("k % 10 <> 0").drop("k"), clock).select("trace", "ts", "unix_ns")


# ---- tables of system traces ----


def _trace_events(s, d):
    tables = trace_tables(s, d)
    return tables, traced.events(tables, traced.realtime(tables["clock_snapshot"]))


def _notes(column):
    return F.array_join(F.transform(column, lambda a: F.concat(a["key"], F.lit("="), F.coalesce(a["string_value"], a["int_value"].cast("string")))), ";")


@query("k11_trace_logs", "SELECT trace, kind, id, ts, unix_ns, body, attrs FROM timed", TRACE_TABLES)
def k11_trace(s, d):
    return _trace_events(s, d)[1].select("trace", "kind", "id", "ts", "unix_ns", "body", _notes("attributes").alias("attrs"))


@query("u3_trace_order", "SELECT trace, row_number() OVER (PARTITION BY trace ORDER BY unix_ns, kind_no, ts, id, body) AS place, kind, ts, body FROM timed", TRACE_TABLES)
def u3_trace(s, d):
    return traced.placed(_trace_events(s, d)[1].drop("attributes")).select("trace", "place", "kind", "ts", "body")


@query(
    "a23_trace_totals",
    """, n AS (SELECT trace, max(unix_ns) + 1 AS unix_ns, count(*) FILTER (kind = 'slice') AS slices FROM timed GROUP BY trace), m AS (SELECT n.*, (SELECT count(*) FROM customer WHERE (c_custkey % 3)::VARCHAR = trace) AS threads,
(SELECT count(*) FROM nation WHERE (n_nationkey % 3)::VARCHAR = trace) AS processes FROM n)
SELECT *, 'Perfetto trace analysis complete: ' || slices || ' slices, ' || threads || ' threads, ' || processes || ' processes' AS body FROM m""",
    TRACE_TABLES,
)
def a23_trace(s, d):
    return traced.totals(*_trace_events(s, d))


@query(
    "s21_argument_sets",
    """SELECT (g % 3)::VARCHAR AS trace, g AS arg_set_id, string_agg('arg.' || (p_partkey % 5) || '=' || CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_size::VARCHAR ELSE round(p_retailprice * 100)::BIGINT::VARCHAR END, ';' ORDER BY p_partkey) AS arguments
FROM (SELECT *, p_partkey // 5 AS g FROM part) GROUP BY g""",
    "",
)
def s21_args(s, d):
    value = lambda v: F.coalesce(v["string_value"], v["int_value"].cast("string"), F.round(v["real_value"] * 100).cast("long").cast("string"))
    entries = F.transform(F.array_sort(F.map_entries("arguments")), lambda e: F.concat(e["key"], F.lit("="), value(e["value"])))
    return traced.argument_sets(trace_tables(s, d)["args"]).select("trace", "arg_set_id", F.array_join(entries, ";").alias("arguments"))


def _sql_time(ts):
    return f"(SELECT greatest(0, CASE WHEN a.ts IS NULL THEN b.unix - (b.ts - {ts}) WHEN b.ts IS NULL THEN a.unix + ({ts} - a.ts) ELSE a.unix + (({ts} - a.ts)::HUGEINT * (b.unix - a.unix) // (b.ts - a.ts))::BIGINT END))"


@query(
    "k12_trace_spans",
    f""", s AS (SELECT *, ts + dur AS fin FROM slice WHERE trace IN (SELECT trace FROM clock)), x AS (SELECT s.*, {_sql_time("s.ts")} AS start_ns FROM s ASOF LEFT JOIN clock a ON s.trace = a.trace AND s.ts >= a.ts ASOF LEFT JOIN clock b ON s.trace = b.trace AND s.ts < b.ts),
y AS (SELECT x.*, {_sql_time("x.fin")} AS end_ns FROM x ASOF LEFT JOIN clock a ON x.trace = a.trace AND x.fin >= a.ts ASOF LEFT JOIN clock b ON x.trace = b.trace AND x.fin < b.ts),
z AS (SELECT *, (row_number() OVER (PARTITION BY trace ORDER BY ts, id, name NULLS FIRST, dur) - 1) // 200 AS batch FROM y)
SELECT trace, md5(trace) AS trace_id, printf('%016x', id) AS big_end, CASE WHEN parent_id IS NULL THEN 0 ELSE 16 END AS parent_digits, coalesce(name, 'slice-' || id) AS name, start_ns, end_ns,
concat_ws(';', 'perfetto.slice.id=' || id, 'perfetto.slice.ts=' || ts, 'perfetto.slice.dur_ns=' || dur, 'perfetto.slice.track_id=' || track_id, 'perfetto.slice.depth=' || depth) AS attrs, batch, min(start_ns) OVER (PARTITION BY trace, batch) AS batch_ns FROM z""",
    TRACE_TABLES,
)
def k12_trace(s, d):
    tables = trace_tables(s, d)
    big_end = F.regexp_replace("span_id", "(..)" * 8, "$8$7$6$5$4$3$2$1").alias("big_end")
    return traced.spans(tables["slice"], traced.realtime(tables["clock_snapshot"])).select("trace", "trace_id", big_end, F.length("parent_span_id").alias("parent_digits"), "name", "start_ns", "end_ns", _notes("attributes").alias("attrs"), "batch", "batch_ns")


@query(
    "k13_gauges",
    """SELECT o_orderkey, 0::BIGINT AS position, 'count' AS name, '' AS description, '' AS unit, o_orderkey::DOUBLE AS value, '' AS labels FROM orders UNION ALL SELECT o_orderkey, 1, 'price', 'total', 'usd', o_totalprice, 'priority=' || o_orderpriority FROM orders
UNION ALL SELECT o_orderkey, 2, 'price.owner', '', '', o_custkey::DOUBLE, 'segment=' || o_orderstatus FROM orders""",
    "",
)
def k13_gauges(s, d):
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("labels")
    return traced.gauges(metrics_json(s, d), "o_orderkey", "metrics").select("o_orderkey", "position", "name", "description", "unit", "value", labels)


# ---- traces ----


@query("j5_span_tree", "SELECT c.trace_id, c.span_id, c.name, p.name AS parent_name, p.start_ns AS parent_start_ns FROM spans c LEFT JOIN spans p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id", SPANS)
def j5(s, d):
    return traces.with_parent(spans(s, d)).select("trace_id", "span_id", "name", "parent_name", "parent_start_ns")


_D = "greatest(end_ns - start_ns, 0)"


@query("a24_latency", f"SELECT name, count(*) AS spans, min({_D}) AS min_ns, max({_D}) AS max_ns, round(avg({_D}), 3) AS mean_ns, round(quantile_cont({_D}, 0.5), 3) AS p50_ns, round(quantile_cont({_D}, 0.95), 3) AS p95_ns, round(quantile_cont({_D}, 0.99), 3) AS p99_ns FROM spans GROUP BY name", SPANS)
def a24(s, d):
    return traces.latencies(spans(s, d), "name")


@query("w7_filtered_rewrite", "SELECT record_type, seq, ts_unix_ns FROM (SELECT 'logs' AS record_type, seq, ts_ns AS ts_unix_ns, k FROM logs) WHERE k < 20")
def w7(s, d):
    return logs(s, d).filter("k < 20").select(F.lit("logs").alias("record_type"), "seq", F.col("ts_ns").alias("ts_unix_ns"))


@query("w8_dedup_emit", "SELECT row_number() OVER (ORDER BY first_seen, first_pos) - 1 AS new_seq, representative, n, (last_seen - first_seen) // 1000000 AS span_ms FROM (SELECT event_type, k, count(*) AS n, min(ts_ns) AS first_seen, max(ts_ns) AS last_seen, arg_min(body, seq) AS representative, min(seq) AS first_pos FROM logs GROUP BY 1, 2)")
def w8(s, d):
    g = dedup.groups(logs(s, d), ["event_type", "k"], "seq", "ts_ns", "body")
    out = ordering.numbered(g, ["first_seen", "first_pos"])
    return out.select((F.col("row_no") - 1).cast("long").alias("new_seq"), "representative", "n", F.expr("(last_seen - first_seen) div 1000000").alias("span_ms"))


_ATTRIBUTES = "['service.name', 'http.status', 'httpx', 'custom.key', 'gen_ai.x']"


@query("p25_standard_attributes", f"SELECT key, starts_with(key, 'service.') OR starts_with(key, 'http.') OR starts_with(key, 'gen_ai.') AS standard, count(*) AS n FROM (SELECT {_ATTRIBUTES}[k % 5 + 1] AS key FROM logs) GROUP BY 1, 2")
def p25(s, d):
    key = F.get(F.array(*map(F.lit, ("service.name", "http.status", "httpx", "custom.key", "gen_ai.x"))), F.col("k") % 5)
    return logs(s, d).groupBy(key.alias("key"), attributes.is_standard(key).alias("standard")).agg(F.count(F.lit(1)).alias("n"))


@query("d16_collapse_full")
def d16(s, d):
    return templates.collapsed(logs(s, d), "service_name", "seq", "body", "ts_ns", 0.3)


@query("d18_metadata", "SELECT min(ts_ns) AS time_ns, max(ts_ns) AS observed_ns, arg_min(body, seq) AS body, count(*) AS dedup_count, 'distinct/canon' AS dedup_mode, 'distinct' AS dedup_behaviour, 'canon' AS dedup_matcher, 'global' AS dedup_scope, 'whole-selection' AS dedup_window, (max(ts_ns) - min(ts_ns)) // 1000000 AS dedup_time_span_ms FROM logs GROUP BY event_type, k")
def d18(s, d):
    return dedup.described(dedup.groups(logs(s, d), ["event_type", "k"], "seq", "ts_ns", "body"), "distinct", "full")


@query("u2_passthrough", "SELECT kind, count(*) AS n FROM (SELECT DISTINCT 'group' AS kind, body FROM logs WHERE k < 50 UNION ALL SELECT 'other', body FROM logs WHERE k >= 50) GROUP BY 1")
def u2(s, d):
    rows = logs(s, d)
    grouped = dedup.groups(rows.filter("k < 50"), ["body"], "seq", "ts_ns", "body").select(F.lit("group").alias("kind"))
    return grouped.unionByName(rows.filter("k >= 50").select(F.lit("other").alias("kind"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("a21_counters", "SELECT event_type AS value, count(*) AS n, count(*) // 1000 AS reports FROM logs GROUP BY 1")
def a21(s, d):
    return summary.count_by(logs(s, d), "event_type").withColumn("reports", F.expr("n div 1000"))


@query("j2_thread_names", "SELECT s.trace_id, s.span_id, p.o_orderpriority AS process FROM spans s LEFT JOIN orders p ON s.trace_id = p.o_orderkey", SPANS)
def j2(s, d):
    names = table(s, d, "orders").select(F.col("o_orderkey").alias("trace_id"), F.col("o_orderpriority").alias("process"))
    return spans(s, d).join(names, "trace_id", "left").select("trace_id", "span_id", "process")


@query("t12_rebatch", "SELECT service_name, severity_text, (row_number() OVER (PARTITION BY service_name, severity_text ORDER BY seq) - 1) // 50 AS part, seq FROM logs")
def t12(s, d):
    from tallybrook.streaming.limits import rebatched

    out = rebatched(logs(s, d), "service_name", "severity_text", "seq", 50)
    return out.select("service_name", "severity_text", "part", F.explode("members").alias("seq"))


@query(
    "d19_emitted",
    """, r AS (SELECT seq, ts_ns, event_type || ' k=' || k AS body, seq % 50 = 0 AS passes, CASE WHEN seq % 7 = 0 THEN repeat('0', 32) ELSE format('{:032x}', seq) END AS trace FROM logs),
g AS (SELECT body, count(*) AS n, min(ts_ns) AS ts, max(ts_ns) AS last_seen, min(seq) AS pos, arg_min(trace, seq) AS trace, max(seq) FILTER (seq % 7 <> 0) AS good FROM r WHERE NOT passes GROUP BY body),
u AS (SELECT 'logs' AS record_type, ts, 0 AS late, pos, body, n, last_seen, trace || CASE WHEN good > pos THEN ',' || format('{:032x}', good) ELSE '' END AS trace_ids FROM g UNION ALL SELECT 'events', ts_ns, 1, seq, NULL, NULL, NULL, NULL FROM r WHERE passes)
SELECT record_type, row_number() OVER (ORDER BY ts, late, pos) - 1 AS new_seq, ts AS ts_unix_ns, body, n AS dedup_count, (last_seen - ts) // 1000000 AS span_ms, trace_ids FROM u""",
)
def d19(s, d):
    rows = otlp.flatten(emission.deduplicated(log_requests(s, d), "exact"))
    added = lambda key: F.get_json_object("log_attributes_json", f"$['dedup.{key}']")
    return rows.select(
        F.col("signal_type").alias("record_type"), F.col("sequence").alias("new_seq"), F.col("timestamp_unix_ns").alias("ts_unix_ns"), F.col("body_string").alias("body"),
        added("count").cast("long").alias("dedup_count"), added("time_span_ms").cast("long").alias("span_ms"), added("exemplar_trace_ids").alias("trace_ids"),
    )


_AT = lambda c: f"strftime(make_timestamp({c} // 1000), '%Y-%m-%d %H:%M:%S') || '.000000000 UTC'"


@query(
    "p16_messages",
    f"""SELECT trace_id, span_id, 'Span: ' || name || chr(10) || '  Trace ID: ' || format('{{:032x}}', trace_id) || chr(10) || '  Span ID: ' || format('{{:016x}}', span_id) || chr(10)
|| coalesce('  Parent Span ID: ' || format('{{:016x}}', parent_span_id) || chr(10), '') || '  Kind: ' || ['Unknown(0)', 'Internal', 'Server', 'Client', 'Producer', 'Consumer'][span_id % 6 + 1] || chr(10)
|| '  Start: ' || {_AT("start_ns")} || chr(10) || '  End:   ' || {_AT("end_ns")} || chr(10) || '  Attr: line=' || span_id || chr(10) AS message FROM spans""",
    SPANS,
)
def p16(s, d):
    return span_requests(s, d).select("trace_id", "span_id", rendering.message(F.col("record_type"), F.col("payload")).alias("message"))


_LINE = lambda i, key, value: f"struct_pack(position := {i}::INTEGER, key := '{key}', value := {value})"
_HEAD = ", ".join([_LINE(0, "type", "CASE WHEN seq % 50 = 0 THEN 'events' ELSE 'logs' END"), _LINE(1, "seq", "seq::VARCHAR"), _LINE(2, "ts_unix_ns", "ts_ns::VARCHAR"), _LINE(3, "time", "strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d %H:%M:%S') || '.' || lpad((ts_ns % 1000000000)::VARCHAR, 9, '0') || ' UTC'")])
_REST = ", ".join(_LINE(i + 5, k, v) for i, (k, v) in enumerate({"otlp.kind": "'logs'", "resources": "'1'", "service.name": "service_name", "resource.attrs": "'1'", "scope.attrs": "'0'", "record.attrs": "'0'", "resource.service.name": "service_name", "trace_id": "'1 present'"}.items()))


@query("p17_record_lines", f"SELECT seq, u.position AS position, u.key AS key, u.value AS value FROM (SELECT seq, unnest(CASE WHEN seq % 50 = 0 THEN [{_HEAD}] ELSE [{_HEAD}, {_REST}] END) AS u FROM logs)")
def p17_lines(s, d):
    return record_info.record_info(log_requests(s, d)).filter("key <> 'payload_bytes'")
