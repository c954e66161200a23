"""Split scans, block index and discovery against whole scans and plain versions."""

import json
import random
from collections import Counter

import pytest

from tallybrook.operators import discover
from tallybrook.sources import blocks, otlp
from tests.test_blocks import _attribute, _field, packed


def request(service, severities):
    resource = _field(1, _attribute("service.name", service)) if service else b""
    scope = b"".join(_field(2, _field(3, s.encode()) + _field(5, _field(1, b"text"))) for s in severities)
    return _field(1, _field(1, resource) + _field(2, scope))


def records(n, seed=1, first=0):
    rng, out = random.Random(seed), []
    for i in range(first, first + n):
        kind = rng.choice(["logs", "logs", "logs", "metrics", "events"])
        payload = request(rng.choice(["api", "db", f"svc{i // 40}", None]), [rng.choice(["INFO", "ERROR", ""]) for _ in range(rng.randint(0, 3))]) if kind == "logs" else bytes(rng.randrange(256) for _ in range(30))
        if i % 17 == 0:
            payload = b"\xff\xff" + blocks.SYNC * 3  # can't be read, and has markers inside
        out.append((kind, i, 1000 * i, payload))
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("blocks")
    for f in range(3):
        (path / f"f{f}.blk").write_bytes(b"junk" * 5 + packed(records(200, f, 200 * f), f % 3, 600))
    damaged = bytearray(packed(records(100, 9, 900), 0, 600))
    damaged[len(damaged) // 2] ^= 0x5A
    (path / "g.blk").write_bytes(bytes(damaged) + b"tail")
    (path / "h.blk").write_bytes(b"")
    return path


def whole(folder):
    out = []
    for f in sorted(folder.glob("*.blk")):
        out += [(f.name, block.offset, i, *r) for block, found, _ in blocks.blocks(f.read_bytes()) if block is not None for i, r in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("split", [97, 1000, 1 << 20])
def test_each_record_comes_once_however_files_are_split(spark, folder, split):
    got = blocks.read(spark, str(folder), split_bytes=split)
    rows = sorted((r.file.rsplit("/", 1)[1], r.block_offset, r.position, r.record_type, r.seq, r.ts_unix_ns, bytes(r.payload)) for r in got.collect())
    assert rows == whole(folder) and 600 < len(rows) < 700
    sizes = sum(f.stat().st_size for f in folder.glob("*.blk"))
    assert got.rdd.getNumPartitions() >= sizes // split
    stats = {r.file.rsplit("/", 1)[1]: r for r in blocks.statistics(spark, "file://" + str(folder), split).collect()}
    for f in folder.glob("[fg]*.blk"):
        found = [*blocks.blocks(f.read_bytes())]
        ok = [(b, r, gap) for b, r, gap in found if b is not None]
        skipped = f.stat().st_size - sum(b.length for b, _, _ in ok)
        assert (stats[f.name].blocks_ok, stats[f.name].bytes_skipped, stats[f.name].records) == (len(ok), skipped, sum(len(r) for _, r, _ in ok))
        assert stats[f.name].blocks_bad == sum(b is None and gap < 0 for b, _, gap in found)


def test_index_and_reads_by_offset(spark, folder):
    index = blocks.index(spark, str(folder), 500)
    by_block = {}
    for file, offset, _, kind, seq, ts, payload in whole(folder):
        by_block.setdefault((file, offset), []).append((kind, seq, ts, payload))
    rows = {(r.file.rsplit("/", 1)[1], r.block_offset): r for r in index.collect()}
    assert rows.keys() == by_block.keys()
    for key, found in by_block.items():
        r, seqs = rows[key], [x[1] for x in found]
        services = {s for x in found if x[0] == "logs" for s, _ in otlp.log_events(x[3]) if s}
        assert (r.records, r.first_seq, r.last_seq, r.min_seq, r.max_seq, set(r.services), r.services_complete) == (len(found), seqs[0], seqs[-1], min(seqs), max(seqs), services, True)
    some = index.filter("block_offset % 3 = 0")
    want = Counter(x for (f, o), v in by_block.items() if o % 3 == 0 for x in v)
    assert Counter((r.record_type, r.seq, r.ts_unix_ns, bytes(r.payload)) for r in blocks.read_at(some).collect()) == want


CASES = [{}, {"seq_min": 150, "seq_max": 260}, {"ts_max": 90_000, "types": ["logs"]}, {"services": ["svc3"]}, {"services": ["api", "db"], "severities": ["ERROR"]}, {"types": ["traces"]}, {"seq_min": 10_000}]


@pytest.mark.parametrize("case", CASES)
def test_discovery_agrees_with_a_whole_scan(spark, folder, case):
    index = blocks.index(spark, str(folder)).persist()
    opened = []

    def at(places):
        opened.append(places.count())
        return discover.with_events(blocks.read_at(places))

    files, events = discover.discover(index, at, **case)
    got = {r.file.rsplit("/", 1)[1]: r for r in files.collect()}
    counts, kinds = {}, Counter()
    for file, _, _, kind, seq, ts, payload in whole(folder):
        told = otlp.log_events(payload) if kind == "logs" else []
        hit = case.get("seq_min", 0) <= seq <= case.get("seq_max", 10**9) and ts <= case.get("ts_max", 10**18) and kind in case.get("types", [kind])
        for i, name in enumerate(("services", "severities")):
            if name in case:
                hit = hit and all(not e[i] or e[i] in case[name] for e in told)
        if hit:
            passed = [e for e in told if ("services" not in case or e[0] in case["services"]) and ("severities" not in case or e[1] in case["severities"])]
            c = counts.setdefault(file, [0, 0, ts, ts])
            c[0], c[1], c[2], c[3] = c[0] + 1, c[1] + len(passed), min(c[2], ts), max(c[3], ts)
            kinds.update(("service", s) for s, _ in passed if s)
            kinds.update(("severity", t or "<unset>") for _, t in passed)
    assert {f: [r.records_matched, r.log_events, r.first_ts, r.last_ts] for f, r in got.items() if r.records_matched} == counts
    assert {(r.kind, r.value): r.n for r in events.collect()} == kinds
    assert got.keys() == {"f0.blk", "f1.blk", "f2.blk", "g.blk"} and all(r.records_scanned == 0 for r in got.values() if r.skipped_by_index)
    if case.get("seq_min") == 150:
        assert got["g.blk"].skipped_by_index and not got["f1.blk"].skipped_by_index and opened[0] < index.count() / 3
    if case.get("seq_min") == 10_000:
        assert opened == [0] and all(r.skipped_by_index for r in got.values())


def test_nested_response_and_pages(spark, folder):
    index = blocks.index(spark, str(folder)).persist()
    at = lambda places: discover.with_events(blocks.read_at(places))
    files, events = discover.discover(index, at, offset=1, limit=2)
    told = json.loads(discover.response(files, events, 4, 1, 2, top=2).first().response)
    assert told["ok"] and told["input"] == {"files_total": 4, "offset": 1, "limit": 2, "files_scanned": 2, "next_offset": 3}
    assert [f["path"].rsplit("/", 1)[1] for f in told["files"]] == ["f1.blk", "f2.blk"] and told["summary"]["records_matched"] == 400
    counts = {(r.kind, r.value): r.n for r in events.collect()}
    assert told["summary"]["top_services"] == [{"value": v, "count": n} for (k, v), n in sorted(counts.items(), key=lambda x: (-x[1], x[0][1])) if k == "service"][:2]
    assert [c["value"] for c in told["summary"]["severity_breakdown"]] == sorted(v for k, v in counts if k == "severity")
    for bad in ({"limit": 0}, {"offset": 9}, {"services": [""]}, {"severities": []}):
        with pytest.raises(ValueError):
            discover.discover(index, at, **bad)


def test_summaries_hold_sixteen_values(spark, tmp_path):
    rows = [("logs", i, i, request(f"s{i:02d}", ["INFO"])) for i in range(17)]
    (tmp_path / "a.blk").write_bytes(packed(rows, 0, 1 << 20))
    r = blocks.index(spark, str(tmp_path)).first()
    assert (len(r.services), r.services_complete, r.severities, r.severities_complete) == (16, False, ["INFO"], True)
    index = blocks.index(spark, str(tmp_path))
    assert index.filter(discover.may_match(services=["s16"])).count() == 1 and index.filter(discover.may_match(severities=["WARN"])).count() == 0
