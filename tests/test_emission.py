"""Deduplication end to end: blocks in, groups with attributes and passed records out, against a plain version."""

import json
import struct

import pytest
import xxhash

from tallybrook.operators import emission
from tallybrook.sources import blocks, otlp
from tests.test_blocks import packed

NAMES = "count mode behaviour matcher scope window signature first_seen_ns last_seen_ns time_span_ms exemplar_trace_ids exemplar_span_ids".split()


def log(body, at, trace="", service="api", observed=0, extra=b"", severity=9):
    record = otlp.encoded_fixed(1, at) + otlp.encoded(2, severity) + otlp.encoded(5, otlp.encoded(1, body, True), True) + extra + otlp.encoded(9, bytes.fromhex(trace)) + otlp.encoded(10, bytes.fromhex(trace[:16])) + otlp.encoded_fixed(11, observed)
    scope = otlp.encoded(1, "scope") + otlp.encoded(2, "1.0") + otlp.encoded(3, otlp.entry("in", "s"))
    return otlp.encoded(1, otlp.encoded(1, otlp.encoded(1, otlp.entry("service.name", service)), True) + otlp.encoded(2, otlp.encoded(1, scope) + otlp.encoded(2, record)))


def id_of(i):
    return f"{i:032x}"


@pytest.fixture(scope="module")
def records():
    """Equal bodies with ids and none, free text alike but for numbers, JSON, unreadable payloads and other kinds between them."""
    out = []
    for i in range(120):
        at = 10**9 + (i * 7919 % 120) * 10**7
        if i % 10 == 0:
            out.append(("metrics", i, at, b"points"))
        elif i % 15 == 1:
            out.append(("logs", i, at, b"\x0a\xff\xff"))
        elif i % 3 == 0:
            out.append(("logs", i, at, log("same text", at, id_of(i if i % 4 else 0))))
        elif i % 3 == 1:
            out.append(("logs", i, at, log(f"took {1000 + i} ms", 0, id_of(i), observed=at, extra=otlp.encoded(6, otlp.entry("n", i)))))
        else:
            out.append(("logs", i, at, log(f'{{"a": {5000 + i % 7}}}', at)))
    return out


@pytest.fixture(scope="module")
def folder(records, tmp_path_factory):
    path = tmp_path_factory.mktemp("in")
    (path / "a.blk").write_bytes(packed(sorted(records[:60], key=lambda r: r[1]), 1, 500))
    (path / "b.blk").write_bytes(packed(records[60:], 2, 300))
    return str(path)


def rendered(spark, df, out):
    """Written as blocks, read back: (kind, seq, ts, payload) by number."""
    df.write.format("recordblocks").mode("append").save(out)
    rows = sorted((r.seq, r.record_type, r.ts_unix_ns, bytes(r.payload)) for r in blocks.read(spark, out).collect())
    assert [r[0] for r in rows] == list(range(len(rows)))
    return rows


def plain(records, key):
    groups = {}
    for kind, seq, ts, payload in records:
        if kind != "logs" or payload == b"\x0a\xff\xff":
            continue
        row = next(iter(otlp.log_rows(payload)))
        at = row["timestamp_unix_ns"] or row["observed_timestamp_unix_ns"]
        g = groups.setdefault(key(row["body_string"]), {"n": 0, "first": at, "last": at, "ids": [row["trace_id"]], "body": row["body_string"]})
        if g["n"] and row["trace_id"].strip("0"):
            g["ids"] = [g["ids"][0], row["trace_id"]]
        g["n"], g["first"], g["last"] = g["n"] + 1, min(g["first"], at), max(g["last"], at)
    return groups


def attributes(payload):
    """Of the request's log record: (own fields, attributes)."""
    row = next(iter(otlp.log_rows(payload)))
    return row, json.loads(row["log_attributes_json"])


def test_exact_groups_come_out_with_their_attributes_and_the_rest_passes(spark, records, folder, tmp_path):
    rows = rendered(spark, emission.deduplicated(blocks.read(spark, folder), "exact"), str(tmp_path / "out"))
    groups = plain(records, lambda body: body)
    passed = [r for r in records if r[0] != "logs" or r[3] == b"\x0a\xff\xff"]
    assert sorted(r[1:] for r in rows if (r[1], r[2], r[3]) in {(k, t, p) for k, _, t, p in passed}) == sorted((k, t, p) for k, _, t, p in passed)
    made = [r for r in rows if r[1] == "logs" and r[3] != b"\x0a\xff\xff"]
    assert len(made) == len(groups) and [r[2] for r in rows] == sorted(r[2] for r in rows)
    for _, _, ts, payload in made:
        row, found = attributes(payload)
        g = groups[row["body_string"]]
        assert (ts, row["timestamp_unix_ns"], row["observed_timestamp_unix_ns"]) == (g["first"], g["first"], g["last"])
        assert [k for k in found if k.startswith("dedup.")] == sorted(f"dedup.{n}" for n in NAMES)
        assert (found["dedup.count"], found["dedup.mode"], found["dedup.scope"], found["dedup.window"]) == (g["n"], "distinct/exact", "global", "whole-selection")
        assert found["dedup.signature"] == f"{xxhash.xxh3_64_intdigest(row['body_string'].encode()):016x}"
        assert (found["dedup.first_seen_ns"], found["dedup.last_seen_ns"], found["dedup.time_span_ms"]) == (g["first"], g["last"], (g["last"] - g["first"]) // 10**6)
        assert found["dedup.exemplar_trace_ids"] == ",".join(g["ids"])
        assert (row["service_name"], row["scope_name"], row["scope_version"], row["scope_attributes_json"], row["trace_flags"]) == ("api", "scope", "", '{"in":"s"}', 0)
        assert ("n" in found) == row["body_string"].startswith("took")


def test_canonical_groups_keep_the_first_exemplars(spark, records, folder, tmp_path):
    rows = rendered(spark, emission.deduplicated(blocks.read(spark, folder), "hash2"), str(tmp_path / "out"))
    made = [attributes(r[3]) for r in rows if r[1] == "logs" and r[3] != b"\x0a\xff\xff"]
    groups = plain(records, lambda body: body.split()[0][:1])
    assert sorted(f["dedup.count"] for _, f in made) == sorted(g["n"] for g in groups.values())
    forms = {f["dedup.canonical_body"]: (row, f) for row, f in made}
    assert set(forms) == {"same text", "took _N_ ms", '{"a":0}'}
    row, found = forms["took _N_ ms"]
    first = next(r for r in records if b"took" in r[3])
    assert found["dedup.body_shape"] == "freetext" and row["trace_id"] == id_of(first[1]) == found["dedup.exemplar_trace_ids"] and found["n"] == first[1]
    assert forms['{"a":0}'][1]["dedup.body_shape"] == "json"
    assert all(f["dedup.signature"] == f"{xxhash.xxh3_64_intdigest(form.encode()):016x}" and "dedup.drain3_template" not in f for form, (_, f) in forms.items())
    assert {f["dedup.mode"] for _, f in made} == {"distinct/canon"}


def test_mined_groups_have_template_and_cluster(spark, tmp_path):
    words = ["alpha", "bravo", "delta", "gamma"]
    (tmp_path / "a.blk").write_bytes(packed([("logs", i, 10**9 + i, log(f"user {w} logged in from home", 10**9 + i, id_of(i + 1))) for i, w in enumerate(words)] + [("logs", 9, 10**9 + 9, log("quite different", 10**9 + 9))]))
    rows = rendered(spark, emission.deduplicated(blocks.read(spark, str(tmp_path)), "full"), str(tmp_path / "out"))
    (mined, one), (_, other) = (attributes(r[3]) for r in rows)
    assert one["dedup.drain3_template"] == "user <*> logged in from home" and one["dedup.drain3_cluster_id"] == 1
    assert (one["dedup.count"], one["dedup.mode"], one["dedup.exemplar_trace_ids"], mined["body_string"]) == (4, "distinct/drain3", id_of(1), "user alpha logged in from home")
    assert one["dedup.signature"] == f"{xxhash.xxh3_64_intdigest(b'user <*> logged in from home'):016x}"
    assert other["dedup.mode"] == "distinct/canon" and "dedup.drain3_template" not in other and len(one) == 16


def test_buckets_keep_services_apart_and_source_lines_are_read(spark, tmp_path):
    code = otlp.encoded(6, otlp.entry("code.filepath", "a.c")) + otlp.encoded(6, otlp.entry("code.lineno", 7))
    (tmp_path / "a.blk").write_bytes(packed([("logs", i, 10**9, log("x", 5, service=s, extra=code if i % 2 else b"")) for i, s in enumerate(["a", "a", "b", "b"])]))
    flat = emission.unpacked(blocks.read(spark, str(tmp_path)))
    assert sorted((r.service_name, r.code_filepath, r.code_lineno) for r in flat.collect() if r.code_lineno) == [("a", "a.c", 7), ("b", "a.c", 7)]
    sizes = {b: sorted(r.n for r in emission.distinct(flat, "exact", b).collect()) for b in emission.BUCKETS}
    assert sizes == {"global": [4], "default": [2, 2], "scope": [2, 2], "source-line": [1, 1, 1, 1], "scope-source-line": [1, 1, 1, 1]}


def test_nothing_and_nulls(spark):
    schema = "file string, record_type string, seq long, ts_unix_ns long, payload binary, block_offset long, position int"
    assert emission.deduplicated(spark.createDataFrame([], schema), "full").collect() == []
    rows = spark.createDataFrame([("f", "logs", 1, 5, None, 0, 0), ("f", "events", 0, 5, b"e", 0, 1), ("f", "logs", 2, 6, bytearray(), 0, 2)], schema)
    assert [(r.record_type, r.seq, r.payload) for r in emission.deduplicated(rows).orderBy("seq").collect()] == [("events", 0, b"e"), ("logs", 1, None)]


def test_encoding_round_trip():
    assert otlp.any_value(otlp.encoded(3, -5)) == ("int", -5) and otlp.any_value(otlp.encoded(3, 0, True)) == ("int", 0)
    assert otlp.unsigned(otlp.fields(otlp.encoded_fixed(1, 2**63)), 1) == 2**63
    assert struct.unpack("<d", otlp.fields(otlp.encoded_fixed(4, 1.5))[4][0]) == (1.5,)
    with pytest.raises(ValueError):
        emission.distinct(None, "none")


def test_payloads_are_read_once_for_each_use(spark):
    from tallybrook.plans.adapter import log_requests

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    records = log_requests(spark, "/root/testdata/sf0.001")
    n = records.count()
    records = records.mapInPandas(counted, records.schema)
    assert emission.deduplicated(records, "exact").count() > 0
    assert seen.value <= 3 * n  # for groups, for their first records, and for records that pass
