import pytest
from pyspark.sql import functions as F

from tallybrook.operators import dedup, ordering, ranges, retention, templates


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "b string").select(f("b").alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Fake(c1234abc)", "Fake(_HEX_)"),
        ("x17728987830000_c0", "x_N__c0"),
        ("F0110", "F_N_"),
        ("v2", "v2"),
        ("id_deadbeef00", "id__HEX_"),
        ("42 0 99", "42 0 99"),
        ("12345 999", "_N_ _N_"),
        ("worker=F0110 ignore count=45782 route=c0ffee12", "worker=F_N_ ignore count=_N_ route=_HEX_"),
        ("at 10.0.0.255, from 00:1a:2b:3c:4d:5e; in /usr/lib/x", "at _IPV4_, from _MAC_; in _PATH_"),
        ("1.5 0xBEEF deadbeef std::vector", "_F_ _HEX_ _HEX_ std::vector"),
        ("", ""),
        ("grüße 12345", "grüße _N_"),
    ],
)
def test_free_text_tokens(spark, text, want):
    assert one(spark, text, dedup.freetext) == want


@pytest.mark.parametrize(("text", "want"), [("dispatcher=D0110 count=45782 route=48574a68", "dispatcher=D_N_ count=_N_ route=_HEX_"), ("size=7, load=2.5", "size=_N_, load=_F_"), ("=x a=", "=x a=")])
def test_key_values(spark, text, want):
    assert one(spark, text, dedup.key_value) == want


def test_json(spark):
    text = '{"statusCode": 200, "requestId": 22, "id": "00c0ffee-1234-5678-9abc-def012345678", "a": [1, 2], "o": [{"b": 1, "a": 2}], "f": 0.5, "kind": "ok", "big": 5000}'
    want = '{"a":{"__arr":"scalar"},"big":0,"f":0.0,"id":"_UUID_","kind":"ok","o":{"__arr":"object","__shape":["a","b"]},"requestId":0,"statusCode":200}'
    assert one(spark, text, dedup.json_text) == want
    assert one(spark, "no json", dedup.json_text) is None


def test_shapes(spark):
    texts = ['{"a": 1}', "a=1 b=2", "[1:2] nav.cpp:465: go", "plain", '{"a": ']
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, b string").select("i", dedup.shape("b").alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == ["json", "kv", "prefixed", "freetext", "freetext"]


def frame(spark, bodies):
    return spark.createDataFrame([("s", i, i * 10, b) for i, b in enumerate(bodies)], "stream string, pos long, ts long, body string")


def test_exact_groups_keep_the_first_body(spark):
    got = dedup.groups(frame(spark, "PPPQ"), ["body"], "pos", "ts", "body").orderBy("first_pos").collect()
    assert [(r.body, r.n, r.first_seen, r.last_seen) for r in got] == [("P", 3, 0, 20), ("Q", 1, 30, 30)]


def test_runs(spark):
    got = dedup.collapse(frame(spark, "PPQQPP"), "stream", "pos", ["body"], "ts", "body").orderBy("run").collect()
    assert [(r.body, r.n) for r in got] == [("P", 2), ("Q", 2), ("P", 2)]


def test_mined_templates(spark):
    got = templates.mined(frame(spark, [f"lapsed time is {i}" for i in range(2, 6)] + ["other"]), "pos", "body").orderBy("pos").collect()
    assert {r.template for r in got[:4]} == {"lapsed time is <*>"} and len({r.cluster for r in got}) == 2


def test_reduction_of_nothing(spark):
    empty = dedup.groups(frame(spark, "A").filter("pos > 5"), ["body"], "pos", "ts", "body")
    assert dedup.reduction(empty).first().asDict() == {"groups": 0, "events": 0, "reduction_pct": 0.0}


def test_similarity_and_template(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "c"]), ([], []), (["a"], ["a", "b"])], "a array<string>, b array<string>")
    assert [r.x for r in df.select(dedup.similarity("a", "b").alias("x")).collect()] == [0.5, 1.0, 0.0]
    assert df.select(F.array_join(dedup.template("a", "b"), " ").alias("x")).first().x == "a <*>"


def test_runs_by_template(spark):
    got = templates.collapsed(frame(spark, ["lapsed time is 2", "lapsed time is 3", "lapsed time is 4", "other"]), "stream", "pos", "body", "ts").orderBy("first_pos").collect()
    assert [(r.template, r.n) for r in got] == [("lapsed time is <*>", 3), ("other", 1)]


def test_metadata(spark):
    g = dedup.groups(frame(spark, "AB"), ["body"], "pos", "ts", "body").withColumn("t", F.lit("x"))
    r = dedup.described(g, "collapse", "full", "t").first()
    assert (r.dedup_mode, r.dedup_scope, r.dedup_window) == ("collapse/drain3", "bucketed", "consecutive-run")


def test_whole_chain_mines_only_what_is_alone(spark):
    bodies = ["link up", "link up", "job alpha took long", "retry beta took long", "retry gamma took long", "disk full", None, "a b c d", "kernel id=1 up", "kernel id=2 up"]
    df = spark.createDataFrame([(i, 10 * i, b, b) for i, b in enumerate(bodies)], "seq long, ts long, body string, n string")
    got = sorted((r.first_pos, r.n, r.first_seen, r.last_seen, r.representative, r.template) for r in dedup.distinct_full(df.drop("n"), "seq", "ts", "body", 0.7).collect())
    forms = {i: r.f for i, r in enumerate(df.orderBy("seq").select(dedup.canonical("body").alias("f")).collect())}
    by, want = {}, []
    for i, b in enumerate(bodies):
        by.setdefault(forms[i] or "", []).append(i)
    alone = [v[0] for v in by.values() if len(v) == 1]
    want = [(v[0], len(v), 10 * v[0], 10 * v[-1], bodies[v[0]], None) for v in by.values() if len(v) > 1]
    rows = spark.createDataFrame([(i, forms[i] or "") for i in alone], "pos long, body string")
    clusters = {}
    for r in templates.mined(rows, "pos", "body", 0.7).collect():
        clusters.setdefault((r.cluster, r.template), []).append(r.pos)
    for (_, template), v in clusters.items():
        v.sort()
        want.append((v[0], len(v), 10 * v[0], 10 * v[-1], bodies[v[0]], template if len(v) > 1 else None))
    assert got == sorted(want, key=lambda x: x[0]) and sum(g[1] for g in got) == len(bodies)
    assert any(g[5] and "<*>" in g[5] and g[1] == 2 for g in got)


def test_whole_chain_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def body(i):
        seen.add(1)
        return f"user{i} id={i * 7} took{i} k={i % 9}"

    df = spark.range(300).repartition(3).select(F.col("id").alias("seq"), F.col("id").alias("ts"), body("id").alias("body"))
    assert sum(r.n for r in dedup.distinct_full(df, "seq", "ts", "body", 0.6).collect()) == 300 and seen.value == 300


def test_groups_of_equal_bodies_are_not_sorted(spark):
    plan = dedup.groups(frame(spark, "PPQ"), ["body"], "pos", "ts", "body")._jdf.queryExecution().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_plain_tokens_are_of_the_class_that_all_patterns_give(spark, monkeypatch):
    import random

    rng = random.Random(4)
    tokens = [t for kind in ("0123456789", "abcdefABCDEF", "azAZgG", "0a:.-x/", "12\u2028\u0085", "ab\u2028é", "f0'\"") for _ in range(120) if (t := "".join(rng.choice(kind) for _ in range(rng.randint(1, 20))))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i int, c string")
    fast = df.select("i", F.expr(dedup.classified("c")).alias("x"))
    monkeypatch.setattr(dedup, "_plain", lambda token: [])
    slow = df.select("i", F.expr(dedup.classified("c")).alias("x"))
    assert sorted(fast.collect()) == sorted(slow.collect())


# ---- templates against plain versions ----


def tree(rows, threshold, depth=4, children=100):
    """(pos, template, cluster) of (pos, body) by a plain tree: leaves by token count and leading tokens, one pass in order."""
    first = {}
    for pos, body in sorted(rows, reverse=True):
        first[body] = pos
    order = sorted((pos, body) for body, pos in first.items())
    split = {b: (b or "").split() for _, b in order}
    paths = {b: (len(split[b]),) for _, b in order}
    for level in range(max(depth, 3) - 3):
        seen = {}
        for _, b in order:
            if level + 1 < len(split[b]):
                token = split[b][level]
                if any(c in "0123456789" for c in token):
                    token = "<*>"
                elif token != "<*>":
                    own = seen.setdefault(paths[b], [])
                    if token not in own:
                        own.append(token)
                    token = token if own.index(token) < children - 1 else "<*>"
                paths[b] = (*paths[b], token)
    leaves, joined = {}, {}
    for pos, b in order:
        found, mine = leaves.setdefault(paths[b], []), None
        for loose in (0, 1):
            ranked = [(sum(x == y and x != "<*>" for x, y in zip(t, split[b])) + loose * t.count("<*>"), t.count("<*>"), -i) for i, (t, _) in enumerate(found)]
            if mine is None and ranked and (not split[b] or max(ranked)[0] / len(split[b]) >= threshold):
                mine = -max(ranked)[2]
        if mine is None:
            found.append((split[b], pos))
            mine = len(found) - 1
        else:
            found[mine] = ([x if x == y else "<*>" for x, y in zip(found[mine][0], split[b])], found[mine][1])
        joined[b] = (paths[b], mine)
    return sorted((pos, " ".join(leaves[joined[b][0]][joined[b][1]][0]), leaves[joined[b][0]][joined[b][1]][1]) for pos, b in rows)


def runs(rows, threshold):
    """(stream, first_pos, template, n) of (stream, pos, body) in one pass."""
    out, last = [], {}
    for stream, pos, body in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        tokens, now = (body or "").split(), last.get(stream)
        if now and len(now[2]) == len(tokens) and (not tokens or sum(a in (b, "<*>") for a, b in zip(now[2], tokens)) / len(tokens) >= threshold):
            now[2], now[3] = [a if a == b else "<*>" for a, b in zip(now[2], tokens)], now[3] + 1
        else:
            last[stream] = [stream, pos, tokens, 1]
            out.append(last[stream])
    return sorted((str(s), p, " ".join(t), n) for s, p, t, n in out)


def odd_bodies(n, seed=1):
    import random

    rng = random.Random(seed)
    tokens = ["a", "b", "c", "x1", "<*>", "é"]
    return [None if rng.random() < 0.02 else " ".join(rng.choice(tokens) for _ in range(rng.choice((0, 1, 2, 3, 3, 4, 4, 6)))) for _ in range(n)]


@pytest.mark.parametrize(("depth", "children", "threshold"), [(3, 100, 0.5), (4, 100, 0.6), (5, 100, 0.4), (6, 3, 0.5)])
def test_mining_equals_a_plain_tree(spark, monkeypatch, depth, children, threshold):
    monkeypatch.setattr(templates, "CHILDREN", children)
    monkeypatch.setattr(templates.leaves, "__defaults__", (children,))
    bodies = odd_bodies(400, depth)
    got = templates.mined(frame(spark, bodies), "pos", "body", threshold, depth=depth).collect()
    assert sorted((r.pos, r.template, r.cluster) for r in got) == tree(list(enumerate(bodies)), threshold, depth, children)


def test_mining_on_a_whole_table(spark):
    from tallybrook.plans.adapter import logs

    rows = logs(spark, "/root/testdata/sf0.01").select("seq", "body")
    got = templates.mined(rows, "seq", "body", 0.3)
    assert sorted((r.pos, r.template, r.cluster) for r in got.collect()) == tree([tuple(r) for r in rows.collect()], 0.3)
    leaves = templates.leaves(rows.select(F.lit("").alias("bucket"), F.col("seq").alias("pos"), templates.split(F.col("body")).alias("tokens")), 4)
    assert leaves.select("n", "path").distinct().count() >= 5  # one token count, many tasks


def test_delimiters_and_thresholds(spark):
    texts = ["disk_full on node red", "disk_full on node blue"]
    n = lambda th, **kw: templates.mined(frame(spark, texts), "pos", "body", th, **kw).select("cluster").distinct().count()
    assert (n(0.9), n(0.7)) == (2, 1)
    assert templates.mined(frame(spark, texts), "pos", "body", 0.8, delimiters=["_"]).first().template == "disk full on node <*>"


@pytest.mark.parametrize("threshold", [0.3, 0.6, 1.0])
def test_runs_of_one_hot_stream_over_many_ranges(spark, monkeypatch, threshold):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 16)
    bodies = odd_bodies(500, 7) + ["same thing here"] * 60 + [f"same thing {i}" for i in range(60)] + ["p q"] * 3
    rows = [("s" if i % 9 else None, i * i, b) for i, b in enumerate(bodies)]
    df = spark.createDataFrame([(s, p, 10 * p, b) for s, p, b in rows], "stream string, pos long, ts long, body string")
    got = templates.collapsed(df, "stream", "pos", "body", "ts", threshold).collect()
    assert sorted((str(r.stream), r.first_pos, r.template, r.n) for r in got) == runs(rows, threshold)
    assert sum(r.n for r in got) == len(rows) and all(r.first_seen == 10 * r.first_pos for r in got)


def test_runs_on_a_whole_table(spark, monkeypatch):
    from tallybrook.plans.adapter import logs

    monkeypatch.setattr(ranges, "RANGE_ROWS", 1000)
    rows = logs(spark, "/root/testdata/sf0.01").select(F.lit("all").alias("stream"), "seq", "body", "ts_ns")
    got = templates.collapsed(rows, "stream", "seq", "body", "ts_ns", 0.3).collect()
    assert sorted((r.stream, r.first_pos, r.template, r.n) for r in got) == runs([(r.stream, r.seq, r.body) for r in rows.collect()], 0.3)


@pytest.mark.parametrize("text", [False, True])
def test_windows_by_ranges(spark, monkeypatch, text):
    """Running values and previous rows equal those of plain windows, with sparse, null and text keys."""
    from pyspark.sql import Window

    monkeypatch.setattr(ranges, "RANGE_ROWS", 7)
    data = [("ab"[i % 2] if i % 5 else None, None if i == 3 else (f"k{i * i:06d}" if text else i * i), i % 11) for i in range(200)]
    df = spark.createDataFrame(data, f"stream string, pos {'string' if text else 'long'}, v long")
    w = Window.partitionBy("stream").orderBy("pos")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("stream").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.sum("v").over(up).alias("a"), F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"), F.max("v").over(up).alias("c"), F.sum("v").over(down).alias("d"), F.lag("v").over(w).alias("e"))
    got = ranges.running(ranges.ranged(df, "pos"), ["stream"], ["pos"], F.col("v"), "a")
    got = ranges.running(got, ["stream"], ["pos"], F.col("v"), "b", own=False)
    got = ranges.running(got, ["stream"], ["pos"], F.col("v"), "c", "max")
    got = ranges.running(got, ["stream"], ["pos"], F.col("v"), "d", falling=True)
    got = ranges.previous(got, ["stream"], ["pos"], ["v"], "e").withColumn("e", F.col("e.v")).drop("__range")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert ranges.ranged(df, "pos").select("__range").distinct().count() > 5
    assert sorted(r.row_no for r in ordering.numbered(df, ["pos"]).collect()) == list(range(1, 201))


def test_ring_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 5)
    df = spark.createDataFrame([("s", i, 10) for i in range(60)], "stream string, seq long, size int")
    assert sorted(r.seq for r in retention.ring(df, "stream", "seq", 3, 4).collect()) == [0, 1, 2, 56, 57, 58, 59]
    assert sorted(r.seq for r in retention.ring_by_bytes(df, "stream", "seq", F.col("size"), 3, 75).collect()) == [0, 1, 2, 56, 57, 58, 59]
