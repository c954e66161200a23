"""Tables of system traces: texts and rounding, argument sets, order, totals, spans, requests, gauges."""

import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallybrook.operators import parsers, ranges
from tallybrook.sources import otlp
from tallybrook.sources import trace_tables as traced

SCHEMA = {name: "trace string, " + columns for name, (columns, _) in traced.TABLES.items()}


def make(spark, name, rows):
    return spark.createDataFrame(rows, SCHEMA[name])


@pytest.fixture(scope="module")
def clock(spark):
    return traced.realtime(make(spark, "clock_snapshot", [("a", 100, "REALTIME", 1_000_100), ("a", 200, "REALTIME", 1_000_300), ("a", 150, "BOOTTIME", 7)]))


def test_durations_round_as_the_double_does(spark):
    rng = random.Random(3)
    numbers = [*range(2200), *(rng.randrange(1 << rng.randrange(1, 63)) for _ in range(3000)), *(rng.randrange(10**9) * 100 + 50 for _ in range(2000)), (1 << 63) - 1]
    got = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", traced.micros_text(F.col("n")).alias("t")).collect()
    assert [r.t for r in got] == [f"{float(r.n) / 1000:.1f}us" for r in got]
    assert spark.sql("select -1L as n").select(traced.micros_text(F.col("n"))).first()[0] == "running"


def by_hand(clock, ts):
    before = max(((t, u) for t, u in clock if t <= ts), default=None)
    after = min(((t, u) for t, u in clock if t >= ts), default=None)
    if before is None or after is None:
        return 0 if before is after else max(0, after[1] - (after[0] - ts) if before is None else before[1] + ts - before[0])
    if before[0] == after[0]:
        return max(0, before[1])
    product = (ts - before[0]) * (after[1] - before[1])
    return max(0, before[1] + (abs(product) // (after[0] - before[0])) * (1 if product >= 0 else -1))


@pytest.mark.parametrize("points", [0, 100_000])
def test_clock_by_bins_and_by_order(spark, points, monkeypatch):
    rng = random.Random(5)
    clocks = {"a": [(rng.randrange(-(10**6), 10**6) ** 3 // 10**9, rng.randrange(10**15)) for _ in range(150)], "b": [(7, 5)], "c": [(7, 90), (7, 60), (-4, 20)], "d": []}
    rows = [(k, ts) for k, c in clocks.items() for ts in [*(t + d for t, _ in c for d in (-1, 0, 1)), None, -(10**12), 10**12, 7, *(rng.randrange(-(10**9), 10**9) for _ in range(100))]]
    clock = spark.createDataFrame([(k, t, u) for k, c in clocks.items() for t, u in c] + [("b", None, 4), ("b", 3, None), ("d", None, None)], "trace string, ts long, unix long")
    monkeypatch.setattr(parsers, "POINTS", points)
    got = parsers.unix_ns(spark.createDataFrame(rows, "trace string, ts long"), clock).collect()
    assert sorted((r.trace, r.ts or 0, r.unix_ns) for r in got if r.ts is not None) == sorted((k, t, by_hand(clocks[k], t)) for k, t in rows if t is not None)
    assert [r.unix_ns for r in got if r.ts is None] == [0] * 4


def test_few_snapshots_leave_rows_where_they_are(spark, clock):
    rows = make(spark, "instant", [("a", 150, 2, None)])
    plan = parsers.unix_ns(rows, clock)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    crowded = traced.realtime(make(spark, "clock_snapshot", [("a", 1 << i % 61, "REALTIME", i) for i in range(61)] + [("a", i, "REALTIME", i) for i in range(200)]))
    assert parsers.unix_ns(rows, crowded).first().unix_ns == 150


def test_places_move_rows_once_and_without_attributes(spark, clock):
    tables = {"ftrace_event": make(spark, "ftrace_event", [("a", i, 150 + i // 3, "n", 1, None) for i in range(9)])}
    found = traced.events(tables, clock)
    plan = traced.placed(found.drop("attributes"))._jdf.queryExecution().executedPlan().toString()
    assert "perfetto.ftrace" not in plan and "SortMergeJoin" not in plan
    assert [r.place for r in traced.placed(found).orderBy("id").collect()] == [*range(1, 10)]


def code_sizes(spark, df):
    """Bytes of the longest generated method of each stage; the virtual machine doesn't compile methods from 8,000 on."""
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen"))]


def test_texts_and_cut_points_are_short_enough_to_be_compiled(spark, monkeypatch):
    states = spark.range(2000).select("id", F.col("id").alias("ts"), F.col("id").alias("dur"), F.lit("R").alias("state"), F.col("id").alias("utid"))
    sizes = code_sizes(spark, traced.typed(states, "thread_state").select("trace", "id", traced._thread_state()[0].alias("body")))
    assert sizes and max(sizes) < 4000

    monkeypatch.setattr(ranges, "RANGE_ROWS", 1)
    found = ranges.ranged(states.select(F.when(F.col("id") % 100 != 0, F.col("id") * 7 % 1999).alias("at")), "at")
    sizes = code_sizes(spark, found)
    assert sizes and max(sizes) < 4000
    got = sorted(((r.at, r["__range"]) for r in found.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert all(a[1] <= b[1] for a, b in zip(got, got[1:])) and {r for at, r in got if at is None} == {-1}
    assert len({r for _, r in got}) > 400 and max(Counter(r for _, r in got if r >= 0).values()) < 40


def test_gaps_of_the_clock_are_divided_in_64_bits_up_to_their_limits(spark, monkeypatch):
    rng, cases = random.Random(8), []
    for gap in (1, 7, (1 << 45) - 1, *(rng.randrange(1, 1 << 45) for _ in range(40))):
        for drift in (0, 1, min(gap, 1 << 34) - 1, rng.randrange(min(gap, 1 << 34))):
            for sign, whole in ((1, 0), (1, 1), (-1, 1), (1, 3 << 15), (-1, 0)):
                cases += [(at, gap, sign * (whole * gap + drift)) for at in (0, gap - 1, rng.randrange(gap))]
    got = spark.createDataFrame(cases, "at long, gap long, gain long").select("*", parsers._share("at", "gap", "gain").alias("got")).collect()
    assert all(r.got == abs(r.at * r.gain) // r.gap * (1 if r.gain > 0 else -1) for r in got)

    points = [(t, 1_000_000 + t + t * t // 900) for t in range(0, 1000, 9)]
    clock = traced.realtime(make(spark, "clock_snapshot", [("a", t, "REALTIME", u) for t, u in points]))
    rows = spark.range(-20, 1020).select(F.lit("a").alias("trace"), F.col("id").alias("ts"))
    for bits in (45, 2):  # gaps of 9 as long, then as decimals
        monkeypatch.setattr(parsers, "GAP_BITS", bits)
        assert all(r.unix_ns == by_hand(points, r.ts) for r in parsers.unix_ns(rows, clock).collect())


def test_totals_hold_no_rows_of_a_range(spark, clock):
    tables = {"instant": make(spark, "instant", [("a", 150, 2, None)]), "thread": make(spark, "thread", [("a", 1, None, None, None, None)])}
    plan = traced.totals(tables, traced.events(tables, clock))._jdf.queryExecution().optimizedPlan().toString()
    rows_side = [x for x in plan.splitlines() if "Window" in x]
    assert len(rows_side) == 1 and "lead(" in rows_side[0]  # over the clock's own snapshots


def test_six_kinds_in_stable_order(spark, clock):
    tables = {
        "slice": make(spark, "slice", [("a", 1, 150, -1, None, None, 3, None, 2), ("a", 2, 150, 1250, "draw", 1, 3, None, 0), ("b", 3, 5, None, "", None, 1, None, None)]),
        "sched_slice": make(spark, "sched_slice", [("a", 4, 150, 1000, 9, 1, None), ("a", 5, 50, 0, 9, 1, "S")]),
        "thread_state": make(spark, "thread_state", [("a", 6, 300, 2000, 9, None, 1, "lock", 8, 0), ("a", 7, 300, 2000, 9, "R", 0, None, None, None)]),
        "ftrace_event": make(spark, "ftrace_event", [("a", 8, 150, None, None, None)]),
        "spurious_sched_wakeup": make(spark, "spurious_sched_wakeup", [("a", 9, None, None, 4)]),
        "instant": make(spark, "instant", [("a", 150, 2, None), ("a", 150, 2, None)]),
    }
    found = traced.placed(traced.events(tables, clock)).orderBy("trace", "place").collect()
    assert [(r.trace, r.unix_ns, r.body) for r in found] == [
        ("a", 1_000_000, "spurious_wakeup utid=-1"),
        ("a", 1_000_050, "cpu=1 state=S utid=9  dur=0.0us"),
        ("a", 1_000_200, "(unnamed)  dur=running  depth=2"),
        ("a", 1_000_200, "draw  dur=1.2us  depth=0"),
        ("a", 1_000_200, "cpu=1 state=? utid=9  dur=1.0us"),
        ("a", 1_000_200, "? cpu=-1"),
        ("a", 1_000_200, "?"),
        ("a", 1_000_200, "?"),
        ("a", 1_000_400, "state=? dur=2.0us utid=9 cpu=0 io_wait blocked=lock waker=8"),
        ("a", 1_000_400, "state=R dur=2.0us utid=9"),
        ("b", 0, "  dur=0.0us"),
    ]
    assert [(a.key, a.string_value, a.int_value) for a in found[8].attributes] == [("perfetto.ts.id", None, 6), ("perfetto.ts.state", "?", None), ("perfetto.ts.dur_ns", None, 2000), ("perfetto.ts.utid", None, 9), ("perfetto.ts.cpu", None, 0), ("perfetto.ts.io_wait", None, 1), ("perfetto.ts.blocked_function", "lock", None)]
    assert [r.place for r in found] == [*range(1, 11), 1]

    tables |= {"thread": make(spark, "thread", [("a", 1, None, None, None, None), ("c", 1, "t", 1, 1, 1)]), "process": make(spark, "process", [])}
    totals = {r.trace: (r.slices, r.threads, r.processes, r.unix_ns, r.body) for r in traced.totals(tables, traced.events(tables, clock)).collect()}
    assert totals["a"] == (2, 1, 0, 1_000_401, "Perfetto trace analysis complete: 2 slices, 1 threads, 0 processes")
    assert totals["b"][:4] == (1, 0, 0, 1) and totals["c"][:4] == (0, 1, 0, 0)


def test_requests_read_back(spark, clock):
    tables = {"thread_state": make(spark, "thread_state", [("a", 6, 300, -2, 9, None, 1, "ü", 8, 0)])}
    records = traced.requests(traced.events(tables, clock)).select("*", F.lit(1).cast("long").alias("seq"), F.lit("").alias("file"), F.lit(0).cast("long").alias("block_offset"), F.lit(0).alias("position"))
    row = otlp.flatten(records).first()
    assert (row.timestamp_unix_ns, row.observed_timestamp_unix_ns, row.severity_text, row.severity_number, row.service_name) == (1_000_400, 1_000_400, "INFO", 9, "perfetto")
    assert row.body_string == "state=? dur=running utid=9 cpu=0 io_wait blocked=ü waker=8"
    assert json.loads(row.log_attributes_json)["perfetto.ts.dur_ns"] == -2


def test_absent_and_extra_columns_and_empty_tables(spark, clock):
    df = spark.sql("select 5L as ts, 'x' as name, 1 as kind, 2 as __range")
    assert [(r.trace, r.kind, r.body) for r in traced.events({"instant": df}, clock).collect()] == [("", "instant", "x")]
    assert traced.events({"slice": make(spark, "slice", [])}, clock).count() == 0
    assert traced.spans(make(spark, "slice", []), clock).count() == 0
    assert traced.argument_sets(make(spark, "args", [])).count() == 0
    with pytest.raises(ValueError):
        traced.events({}, clock)


def test_argument_sets_are_typed_maps(spark):
    rows = [("a", 1, "k", None, 5, None), ("a", 1, "k", None, 5, None), ("a", 1, "k", "z", None, None), ("a", 1, "d", None, None, 0.5), ("a", None, "k", "n", 1, 1.0), ("a", 2, None, "n", 1, 1.0), ("b", 1, "k", "other", None, None)]
    args = make(spark, "args", rows)
    got = {(r.trace, r.arg_set_id): {k: tuple(v) for k, v in r.arguments.items()} for r in traced.argument_sets(args).collect()}
    assert got == {("a", 1): {"k": (None, 5, None), "d": (None, None, 0.5)}, ("b", 1): {"k": ("other", None, None)}}
    slices = make(spark, "slice", [("a", 7, 0, 0, None, None, 0, 1, 0), ("a", 8, 0, 0, None, None, 0, None, 0)])
    assert {r.id: r.arguments and sorted(r.arguments) for r in traced.with_arguments(slices, args).collect()} == {7: ["d", "k"], 8: None}


def test_spans_come_in_batches(spark, clock):
    slices = make(spark, "slice", [("a", i, 100 + i // 2, 10, None if i == 1 else "n", i - 1 if i else None, 4, None, 1) for i in range(401)] + [("no clock", 1, 1, 1, "n", None, 1, None, 1)])
    got = sorted(traced.spans(slices, clock).collect(), key=lambda r: int.from_bytes(bytes.fromhex(r.span_id), "little"))
    assert [r.batch for r in got] == [i // 200 for i in range(401)]
    assert [(r.span_id, r.parent_span_id, r.name) for r in got[:3]] == [("0" * 16, "", "n"), ("01" + "0" * 14, "0" * 16, "slice-1"), ("02" + "0" * 14, "01" + "0" * 14, "n")]
    assert (got[0].start_ns, got[0].end_ns, got[0].batch_ns, got[200].batch_ns) == (1_000_100, 1_000_120, 1_000_100, got[200].start_ns)
    assert [a.string_value if a.int_value is None else a.int_value for a in got[2].attributes] == ["2", "101", "10", "4", 1]


def test_spans_are_moved_before_their_texts_and_end(spark, clock):
    plan = traced.spans(make(spark, "slice", [("a", 1, 100, 10, "n", None, 4, None, 1)]), clock)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("perfetto.slice.id") == 1 and plan.index("perfetto.slice.id") < plan.index("Window")
    assert "Aggregate [trace" not in plan.split("Window [min(start_ns")[0]


def test_gauges(spark):
    tree = {"b": {"value": 2, "unit": "ms", "description": "d", "host": "h", "n": 3, "deep": {"x": {"value": 1.5}, "value": {"value": 7}}}, "a": 1, "c": True, "d": {"value": "5"}, "e": [{"value": 1}]}
    deep = '{"k":{"k":' * 40 + '{"value":4}' + "}}" * 40
    rows = [(1, json.dumps(tree)), (2, "[1]"), (3, None), (4, "{}"), (5, '{"a":NaN}'), (6, deep), (7, "")]
    got = traced.gauges(spark.createDataFrame(rows, "key int, text string"), "key", "text").orderBy("key", "position").collect()
    one = [(r.name, r.description, r.unit, r.value, r.labels) for r in got if r.key == 1]
    assert one == [("a", "", "", 1.0, {}), ("b", "d", "ms", 2.0, {"host": "h"}), ("b.deep.value", "", "", 7.0, {}), ("b.deep.x", "", "", 1.5, {})]
    assert {r.key for r in got if r.error} == {2, 3, 5, 7} and not any(r.key == 4 for r in got)
    assert [(r.name, r.value) for r in got if r.key == 6] == [(".".join(["k"] * 80), 4.0)]


def test_reading_an_export(spark, tmp_path):
    make(spark, "thread", [("", 2, "b", 1, 1, 0), ("", 1, "a", 1, 1, 1)]).drop("trace", "tid").write.parquet(str(tmp_path / "thread"))
    got = traced.ordered(traced.read(spark, str(tmp_path), "thread"), "thread").collect()
    assert [(r.trace, r.utid, r.name, r.tid) for r in got] == [("", 1, "a", None), ("", 2, "b", None)]


def test_many_lines_meet_their_orders_in_small_parts(spark, monkeypatch):
    from tallybrook.plans import adapter

    sf = "/root/testdata/sf0.001"
    want = adapter.spans(spark, sf).collect()
    monkeypatch.setattr(adapter, "JOIN_LINES", 1000)
    got = adapter.spans(spark, sf)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert sorted(map(tuple, got.filter("span_id > 0").collect())) == sorted(tuple(r) for r in want if r.span_id > 0) and got.count() == len(want)
