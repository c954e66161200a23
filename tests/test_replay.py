"""Replay: resumption, bounded admission with its policies, commits without gaps, draining."""

import json
from collections import Counter

import pytest
from pyspark.errors import StreamingQueryException

from tallybrook.streaming import replay
from tests.test_blocks import packed, sample


@pytest.fixture
def place(spark, tmp_path):
    replay.register(spark)
    (tmp_path / "in").mkdir()
    return tmp_path


def run(spark, place, sink, checkpoint="c", **options):
    stream = spark.readStream.format("recordreplay").options(path=f"file://{place}/in", **options).load()
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(place / checkpoint)).trigger(availableNow=True).start()
    assert q.awaitTermination(120)


def into(out):
    return lambda batch, n: out.append([tuple(r) for r in batch.orderBy("seq", "block_offset", "position").collect()])


def seqs(out):
    return [[r[1] for r in rows] for rows in out if rows]


def test_a_backlog_of_ten_times_the_bound_waits(spark, place):
    (place / "in/a.blk").write_bytes(b"junk" + packed(sample(70), 1, 200))
    (place / "in/b.blk").write_bytes(packed([("logs", 2000 + i, 9 * 10**9, b"x") for i in range(30)], 2, 100))
    out, options = [], {"maxRecords": 10, "state": str(place / "state/s.json"), "splitBytes": 300}
    for _ in range(12):
        run(spark, place, into(out), **options)
    assert seqs(out) == [list(range(1000 + 10 * i, 1010 + 10 * i)) for i in range(7)] + [list(range(2000 + 10 * i, 2010 + 10 * i)) for i in range(3)]
    assert all(r[6] for rows in out for r in rows)


def test_newest_are_dropped_and_counted(spark, place):
    (place / "in/a.blk").write_bytes(packed(sample(100), 1, 200))
    out, lost = [], []

    def sink(batch, n):
        into(out)(batch.filter("admitted"), n)
        lost.append({r.record_type: r.dropped for r in replay.drops(batch).collect()})

    run(spark, place, sink, maxRecords=10, policy="drop-newest", state=str(place / "s.json"))
    assert seqs(out) == [list(range(1000, 1010))]
    assert lost == [dict(Counter(r[0] for r in sample(100)[10:]))]
    (place / "in/b.blk").write_bytes(packed([("logs", 5000 + i, 9 * 10**9, b"x") for i in range(4)]))
    run(spark, place, sink, maxRecords=10, policy="drop-newest", state=str(place / "s.json"))
    assert seqs(out)[1:] == [list(range(5000, 5004))] and lost[1:] == [{}]


def test_a_backlog_disconnects(spark, place):
    (place / "in/a.blk").write_bytes(packed(sample(11)))
    out, options = [], {"policy": "disconnect", "state": str(place / "s.json")}
    with pytest.raises(StreamingQueryException, match="more than 10 records wait"):
        run(spark, place, into(out), maxRecords=10, **options)
    assert out == []
    run(spark, place, into(out), "d", maxRecords=11, **options)
    assert seqs(out) == [list(range(1000, 1011))]


def test_a_failed_middle_batch_leaves_no_gap(spark, place):
    for i in range(3):
        (place / f"in/{i}.blk").write_bytes(packed([("logs", 100 * i + j, 10**9, b"x") for j in range(10)]))
    out, failed, options = [], [], {"maxRecords": 10, "drain": "true", "state": str(place / "s.json")}

    def sink(batch, n):
        if n == 1 and not failed:
            failed.append(n)
            raise RuntimeError("lost")
        into(out)(batch, n)

    run(spark, place, sink, **options)
    with pytest.raises(StreamingQueryException):
        run(spark, place, sink, **options)
    committed = json.loads((place / "s.json").read_text()).get("committed") or {"files": {}}
    assert all(taken == [0, 0] for f, taken in committed["files"].items() if not f.endswith("/0.blk"))
    assert {"1.blk", "2.blk"} <= {f.name for f in (place / "in").iterdir()}
    for _ in range(4):
        run(spark, place, sink, **options)
    assert seqs(out) == [[100 * i + j for j in range(10)] for i in range(3)]


def test_another_identity_starts_again(spark, place):
    (place / "in/_stream").write_text("7\n")
    (place / "in/a.blk").write_bytes(packed(sample(5)))
    out = []
    run(spark, place, into(out), state=str(place / "s.json"))
    run(spark, place, into(out), state=str(place / "s.json"))
    assert seqs(out) == [list(range(1000, 1005))]
    (place / "in/_stream").write_text("8\n")
    run(spark, place, into(out), state=str(place / "s.json"))
    assert seqs(out) == [list(range(1000, 1005))] * 2


def test_a_file_of_lower_numbers_is_read_and_not_drained_unread(spark, place):
    (place / "in/b.blk").write_bytes(packed([("logs", 900 + i, 10**9, b"x") for i in range(3)]))
    out = []
    run(spark, place, into(out), drain="true")
    (place / "in/a.blk").write_bytes(packed([("logs", i, 10**9, b"x") for i in range(3)]))
    run(spark, place, into(out), drain="true")
    run(spark, place, into(out), drain="true")
    assert seqs(out) == [[900, 901, 902], [0, 1, 2]]


def test_where_to_resume():
    saved = {"stream": "1", "after": 50, "files": {"f": [10, 0]}}
    assert replay.reconciled(saved, "1", 3) == saved
    assert replay.reconciled(saved, "2", 90) == {"stream": "2", "after": -1, "files": {}}
    assert replay.reconciled({"after": 50}, None, 40) == {"stream": None, "after": -1, "files": {}}
    assert replay.reconciled({"after": 50}, "1", 60) == {"stream": "1", "after": 50, "files": {}}
    assert replay.reconciled({"after": 50}, None, None)["after"] == 50


def test_last_number_and_bounds(tmp_path):
    f = tmp_path / "a.blk"
    f.write_bytes(packed(sample(40), 1, 150) + b"rest")
    assert replay.last_number(str(f), f.stat().st_size) == 1039
    places, over = replay.admitted({}, {str(f): f.stat().st_size}, 40)
    assert not over and places == {str(f): [f.stat().st_size, 0]}
    places, over = replay.admitted({}, {str(f): f.stat().st_size}, 39)
    assert over
    assert replay.admitted(places, {str(f): f.stat().st_size}, 1) == ({str(f): [f.stat().st_size, 0]}, False)
