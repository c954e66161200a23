import glob
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallybrook.sources import blocks, otlp
from tallybrook.sources.blocks import crc32c
from tallybrook.streaming import replay


def sample(n):
    return [(("logs", "metrics", "traces")[i % 3], 1000 + i, 5 * 10**9 + 100 * i, f"batch-{i}".encode()) for i in range(n)]


def packed(records, codec=1, target=blocks.TARGET):
    return b"".join(blocks.pack(run, codec) for run in blocks.cut(iter(records), target))


def unpacked(content):
    return [r for b, records, _ in blocks.blocks(content) if b is not None for r in records]


def test_checksum():
    assert crc32c(b"123456789") == 0xE3069283
    long = bytes(range(256)) * 70
    state = 0xFFFFFFFF
    for b in long:
        state ^= b
        for _ in range(8):
            state = (state >> 1) ^ (blocks.POLYNOMIAL if state & 1 else 0)
    assert crc32c(long) == state ^ 0xFFFFFFFF


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["logs", "metrics", "traces", "events"]), st.integers(0, 2**62), st.integers(0, 2**62), st.binary(max_size=300)), max_size=20), st.sampled_from([0, 1, 2]), st.sampled_from([48, 1024]))
def test_round_trip(records, codec, target):
    assert unpacked(packed(records, codec, target)) == records


def test_damage_costs_its_block_alone():
    content = bytearray(packed(sample(12), 1, 60))
    second = content.find(blocks.SYNC, 8)
    for i in range(second + 34, second + 40):
        content[i] ^= 0x5A
    got = unpacked(bytes(content))
    assert 8 <= len(got) < 12 and set(got) <= set(sample(12))


@pytest.mark.parametrize("at", [8, 9])
def test_unknown_version_or_codec(at):
    content = bytearray(packed(sample(1)))
    content[at] = 9
    assert unpacked(bytes(content)) == []


def test_sink_and_source(spark, tmp_path):
    blocks.register(spark)
    df = spark.createDataFrame([(*r, 0, 0) for r in sample(50)], "record_type string, seq long, ts_unix_ns long, payload binary, block_offset long, position int")
    path = str(tmp_path / "out")
    df.repartition(3).sortWithinPartitions("seq").write.format("recordblocks").option("codec", "zstd").option("blockTarget", "256").mode("append").save(path)
    got = blocks.read(spark, path)
    assert sorted((r.record_type, r.seq, r.ts_unix_ns, bytes(r.payload)) for r in got.collect()) == sorted(sample(50))
    assert blocks.read(spark, path, seq_max=1009).count() == 10
    stats = blocks.statistics(spark, path).groupBy().sum("blocks_bad", "records").first()
    assert tuple(stats) == (0, 50)
    assert blocks.index(spark, path).selectExpr("min(min_seq)", "max(max_seq)", "sum(records)").first()[:] == (1000, 1049, 50)
    df.write.format("recordblocks").mode("overwrite").save(path)
    assert blocks.read(spark, path).count() == 50


def test_replay_after_a_number(spark, tmp_path):
    replay.register(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.blk").write_bytes(packed(sample(20)))
    (tmp_path / "in/b.blk").write_bytes(packed([("logs", 2000 + i, 9 * 10**9, b"x") for i in range(5)]))
    stream = spark.readStream.format("recordreplay").option("path", str(tmp_path / "in")).option("after", "1009").load()

    def run():
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    run()
    seqs = lambda: sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert seqs() == [*range(1010, 1020), *range(2000, 2005)]
    (tmp_path / "in/c.blk").write_bytes(packed([("logs", 3000, 10**10, b"y")]))
    run()  # goes on from the checkpoint
    assert seqs()[-1] == 3000 and len(seqs()) == 16


def _field(n, value):
    def varint(v):
        out = b""
        while v > 127:
            out, v = out + bytes([v & 127 | 128]), v >> 7
        return out + bytes([v])

    if isinstance(value, int):
        return varint(n << 3) + varint(value)
    if isinstance(value, float):
        return varint(n << 3 | 1) + struct.pack("<d", value)
    if isinstance(value, tuple):
        return varint(n << 3 | 1) + struct.pack("<Q", value[0])
    return varint(n << 3 | 2) + varint(len(value)) + value


def _attribute(k, v):
    return _field(1, k.encode()) + _field(2, _field(1, v.encode()))


def _request(item):
    resource = _field(1, _attribute("service.name", "api"))
    scope = _field(1, b"lib") + _field(2, b"1.0")
    return _field(1, _field(1, resource) + _field(2, _field(1, scope) + item))


def test_otlp_rows(spark):
    log = _field(2, _field(1, (7,)) + _field(2, 17) + _field(3, b"ERROR") + _field(5, _field(1, b"boom")) + _field(6, _attribute("a", "1")) + _field(6, _attribute("a", "2")))
    metric = _field(2, _field(1, b"cpu") + _field(5, _field(1, _field(3, (500,)) + _field(4, 42.5))))
    span = _field(2, _field(1, b"\x01" * 16) + _field(2, b"\x02" * 8) + _field(5, b"GET") + _field(6, 2) + _field(7, (100,)) + _field(8, (1100,)))
    rows = [("logs", 1, 10, _request(log)), ("metrics", 2, 20, _request(metric)), ("traces", 3, 30, _request(span)), ("logs", 4, 40, b"\x0a\xff"), ("events", 5, 50, b"?")]
    got = otlp.flatten(spark.createDataFrame(rows, "record_type string, seq long, ts_unix_ns long, payload binary")).orderBy("sequence").collect()
    assert (got[0].service_name, got[0].severity_number, got[0].body_string, got[0].log_attributes_json, got[0].timestamp_unix_ns) == ("api", 17, "boom", '{"a":"1"}', 10)
    assert (got[1].metric_name, got[1].metric_type, got[1].metric_value_number, got[1].timestamp_unix_ns) == ("cpu", "Gauge", 42.5, 500)
    assert (got[2].span_name, got[2].span_kind, got[2].duration_ns, got[2].span_id) == ("GET", "Server", 1000, "02" * 8)
    assert [r.valid for r in got] == [True, True, True, False, True]


def test_no_leftovers(spark, tmp_path):
    blocks.register(spark)
    df = spark.createDataFrame([("logs", 1, 1, b"x", 0, 0)], "record_type string, seq long, ts_unix_ns long, payload binary, block_offset long, position int")
    df.write.format("recordblocks").mode("append").save(str(tmp_path / "o"))
    assert not glob.glob(str(tmp_path / "o/*.tmp"))


def test_listings(spark, tmp_path):
    from tallybrook.sources import manifest

    for name in ("a.blk", "a-2.blk", "a-10.blk", "b.blk", "a.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert [r.path.rsplit("/", 1)[1] for r in manifest.manifest(spark, str(tmp_path)).collect()] == ["a-10.blk", "a-2.blk", "a.blk", "b.blk"]
    assert [r.segment for r in manifest.segments(spark, str(tmp_path), "a").collect()] == [0, 2, 10]
