import pytest
from pyspark.sql import functions as F

from tallybrook.functions import text
from tallybrook.operators import ordering, parsers, predicates, retention, summary
from tallybrook.streaming import limits


def test_preview_cuts_whole_characters(spark):
    df = spark.createDataFrame([("héllo",), ("ab",), (None,)], "t string")
    assert [r.x for r in df.select(text.preview(F.col("t"), 2).alias("x")).collect()] == ["h...", "ab", None]
    assert df.select(text.preview(F.col("t"), 0).alias("x")).first().x == ""


def test_sizes(spark):
    df = spark.createDataFrame([("5mb",), ("5 MiB",), ("3",), ("x",)], "t string")
    assert [r.x for r in df.select(text.human_size(F.col("t")).alias("x")).collect()] == [5_000_000, 5 << 20, 3072, None]


def test_syslog_lines(spark):
    lines = ["<13>Oct 11 22:14:15 myhost su: pam_unix failed", "<34>Oct 11 22:14:15 box sshd[1234]: accepted key", "no priority"]
    got = parsers.syslog(parsers.lines(spark.createDataFrame([(x,) for x in [*lines, "  "]], "value string"))).collect()
    assert [(r.severity, r.facility, r.host, r.app, r.message) for r in got] == [("INFO", "user", "myhost", "su", "pam_unix failed"), ("FATAL", "auth", "box", "sshd", "accepted key"), ("INFO", "user", None, None, "no priority")]


def test_logcat_lines(spark):
    lines = ["06-11 22:14:15.123  1234  5678 I MyApp   : hello world", "W/dalvikvm( 5678): GC freed 2048 objects", "?"]
    got = parsers.logcat(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.severity, r.tag, r.pid, r.message) for r in got] == [("INFO", "MyApp", 1234, "hello world"), ("WARN", "dalvikvm", 5678, "GC freed 2048 objects"), ("INFO", None, None, "?")]


def test_merge_orders(spark):
    rows = spark.createDataFrame([("f1", 0, 9, 1000, "Luke"), ("f2", 0, 3, 9000, "Leia")], "file string, pos long, seq long, ts long, body string")
    assert [r.body for r in ordering.merged(rows, "file", "pos", "seq", "ts").collect()] == ["Leia", "Luke"]
    assert [r.body for r in ordering.merged(rows, "file", "pos", "ts", "seq").collect()] == ["Luke", "Leia"]


def test_page_limits(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "p string")
    assert [(r.p, r.next_offset) for r in ordering.page(df, "p", 1, 1).collect()] == [("b", 2)]
    with pytest.raises(ValueError, match="limit"):
        ordering.page(df, "p", 0, 0)


def test_keep_rules(spark):
    s = spark.createDataFrame([("x", i, 10) for i in range(5)], "stream string, id int, size long")
    kept = lambda df: sorted(r.id for r in df.filter("kept").collect())
    assert kept(retention.keep_bytes(s, "stream", "id", "size", 25)) == [2, 3, 4]
    assert kept(retention.retained(s, "stream", "id", "size", 25)) == [3, 4]
    assert kept(retention.retained(s, "stream", "id", "size", 1)) == [4]
    assert kept(retention.keep_files(s, "stream", "id", 0)) == [4]


def test_empty_sets_are_errors(spark):
    with pytest.raises(ValueError, match="service"):
        predicates.in_sets(services=[""])


def test_first_last_is_by_position(spark):
    df = spark.createDataFrame([("f", 0, 9), ("f", 1, 3)], "file string, pos int, seq int")
    assert summary.first_last(df, "file", "pos", "seq").first()[1:] == (9, 3)


def drained(spark, tmp_path, df, make, schema):
    source = tmp_path / "in"
    df.coalesce(1).write.parquet(str(source))
    out = make(spark.readStream.schema(schema).parquet(str(source)))
    mode = "append" if "decision" in out.columns else "update"
    q = out.writeStream.format("memory").queryName("got").outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql("SELECT * FROM got").collect()


def test_rate_limit_stream(spark, tmp_path):
    s = 10**9
    rows = [("k", 0, 1), ("k", 1, 1), ("k", 2, 5), ("k", 3, 1), ("k", s, 1)]
    got = drained(spark, tmp_path, spark.createDataFrame(rows, "key string, ts long, p int"), lambda d: limits.rate_limited(d, "key", "ts", "p", 2, 5), "key string, ts long, p int")
    assert [r.decision for r in sorted(got, key=lambda r: r.ts)] == ["accepted", "accepted", "bypass", "rejected", "accepted"]


def test_ring_stream(spark, tmp_path):
    rows = [("k", i) for i in range(10)]
    got = drained(spark, tmp_path, spark.createDataFrame(rows, "key string, seq long"), lambda d: limits.ring(d, "key", "seq", 2, 3), "key string, seq long")
    assert got[-1].held == [0, 1, 7, 8, 9]


def test_rebatch(spark):
    df = spark.createDataFrame([("r", "s", i) for i in range(5)], "r string, s string, pos long")
    assert [x.members for x in limits.rebatched(df, "r", "s", "pos", 2).orderBy("part").collect()] == [[0, 1], [2, 3], [4]]


def test_conditions_are_checked_before_reading(spark):
    from tallybrook.operators import conditions
    from tallybrook.plans.model import wide

    events = wide(spark.createDataFrame([(1, "logs", "up", '{"user":"7"}'), (2, "logs", None, None), (3, "metrics", None, None)], "sequence long, signal_type string, body_string string, log_attributes_json string"))
    ids = lambda signal, c: sorted(r.sequence for r in conditions.matching(events, signal, c).collect())
    assert ids("logs", lambda v: v.attributes["user"] == "7") == [1]
    assert ids("logs", lambda v: ~(v.attributes["user"] == "8")) == [1]  # unset doesn't match
    assert ids("logs", lambda v: v.body == "") == [2] and ids("metrics", lambda v: v.value == 0) == [3]
    for wrong in (lambda v: v.severity_number, lambda v: v.no_such_name == 1, lambda v: True):
        with pytest.raises(ValueError):
            conditions.matching(events, "logs", wrong)
    with pytest.raises(ValueError):
        conditions.matching(events, "trees", lambda v: v.body == "")
