"""Block files of records: (record_type, seq, ts_unix_ns, payload) in compressed, checksummed blocks.

A reader looks for the next sync marker after damage, so one bad block costs no more than its own records. Source and sink are a Python
data source over the stores that pyarrow opens (local folders, HDFS, S3, GCS). A file is read in ranges of bytes, one task each: a range
owns the blocks whose marker lies in it, and begins at the first marker of a good block from its start on. Blocks whose first
sequence number or time is above an upper bound are passed over without being unpacked; blocks chosen from an index are read at their offsets alone.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tallybrook.plans.model import RECORD
from tallybrook.operators import ranges
from tallybrook.sources import otlp

#: Fixed values of the layout: marker, version, lengths of the fixed header and its extension, largest length, types, codecs.
SYNC, VERSION, FIXED, EXTENSION, MOST = b"OTLPBLK!", 1, 24, 16, 16 << 20
TYPES = {1: "logs", 2: "metrics", 3: "traces", 4: "events"}
CODECS = {0: None, 1: "lz4_raw", 2: "zstd"}
HEAD = struct.Struct("<BBHHHIIII")
BASE = struct.Struct("<QQ")
#: Bytes of a file that one task reads.
SPLIT = 64 << 20
#: Values a block's summary holds of services and severities.
SUMMARY = 16
#: Bytes of payload after which a block is closed.
TARGET = 64 << 10
#: Reflected polynomial of CRC-32C.
POLYNOMIAL = 0x82F63B78
LANES = 256


@cache
def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


@cache
def _zeros_after(n: int) -> np.ndarray:
    """Four tables: what a state's bytes become after ``n`` zero bytes."""
    table, out = _crc_table(), np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
    for _ in range(n):
        out = table[out & 255] ^ (out >> 8)
    return out


def crc32c(data: bytes) -> int:
    """CRC-32C; long data in lanes side by side, which are joined by shifting each lane's state over the next lane's length."""
    table, state, at = _crc_table(), np.uint32(0xFFFFFFFF), 0
    if len(data) >= 16 * LANES:
        width = len(data) // LANES
        lanes = np.frombuffer(data, np.uint8, LANES * width).reshape(LANES, width)
        states = np.zeros(LANES, np.uint32)
        states[0] = state
        for i in range(width):
            states = table[(states ^ lanes[:, i]) & 255] ^ (states >> 8)
        shift, at, total = _zeros_after(width), LANES * width, int(states[0])
        for x in states[1:].tolist():
            total = int(shift[0, total & 255]) ^ int(shift[1, total >> 8 & 255]) ^ int(shift[2, total >> 16 & 255]) ^ int(shift[3, total >> 24]) ^ x
        state = total
    small, state = table.tolist(), int(state)
    for b in data[at:]:
        state = small[(state ^ b) & 255] ^ (state >> 8)
    return state ^ 0xFFFFFFFF


class Block(NamedTuple):
    offset: int
    length: int
    codec: int
    plain: int
    packed: int
    count: int
    seq: int
    ts: int
    body: memoryview


def _header(data: memoryview, at: int, check: bool) -> Block | None:
    """The block at a marker, or None if it is damaged."""
    head = at + len(SYNC)
    if head + FIXED > len(data):
        return None
    version, codec, _, length, _, plain, packed, count, crc = HEAD.unpack(data[head : head + FIXED])
    if version != VERSION or codec not in CODECS or length < FIXED + EXTENSION or max(plain, packed) > MOST:
        return None
    body, end = head + length, head + length + packed + 4
    if end > len(data):
        return None
    seq, ts = BASE.unpack(data[head + FIXED : head + FIXED + EXTENSION])
    if check:
        fixed = bytes(data[head : head + FIXED - 4]) + bytes(data[head + FIXED : head + length])
        if crc32c(fixed) != crc or crc32c(bytes(data[head : body + packed])) != int.from_bytes(data[end - 4 : end], "little"):
            return None
    return Block(at, end - at, codec, plain, packed, count, seq, ts, data[body : body + packed])


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at += 1
        if b < 128:
            return value, at
        shift += 7


def unpack(block: Block) -> list[tuple[str, int, int, bytes]]:
    """The block's records; raises for what doesn't fit its header."""
    name = CODECS[block.codec]
    raw = pa.Codec(name).decompress(block.body, block.plain, asbytes=True) if name else bytes(block.body)
    out, at = [], 0
    for _ in range(block.count):
        kind = TYPES[raw[at]]
        seq, at = _varint(raw, at + 1)
        ts, at = _varint(raw, at)
        size, at = _varint(raw, at)
        if at + size > len(raw):
            raise ValueError("record beyond its block")
        out.append((kind, block.seq + seq, block.ts + ts, raw[at : at + size]))
        at += size
    if at != len(raw):
        raise ValueError("bytes after the last record")
    return out


def blocks(content: bytes, check: bool = True, upto: int | None = None) -> Iterator[tuple[Block | None, list, int]]:
    """(block, records, bytes skipped before it) of blocks with a marker before ``upto``; block is None where a marker begins no good block, and at the end."""
    data, at, origin = memoryview(content), 0, 0
    upto = len(content) if upto is None else upto
    while True:
        mark = content.find(SYNC, at)
        if mark < 0 or mark >= upto:
            yield None, [], max(0, upto - origin)
            return
        block = _header(data, mark, check)
        if block is not None:
            try:
                records = unpack(block)
            except (ValueError, KeyError, IndexError, OSError, pa.ArrowException):
                block = None
        if block is None:
            at = mark + 1  # a good block may lie within what looked like one
            yield None, [], -1 - mark
        else:
            yield block, records, mark - origin
            at = origin = mark + block.length


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def listed(paths: list[str], suffix: str = ".blk") -> list[tuple[str, int]]:
    """(address, size) of the files under ``paths``, by path."""
    out = {}
    for path in paths:
        fs, place = store(path)
        prefix = path[: path.index("://") + 3] if "://" in path and not path.startswith("file:") else ""
        info = fs.get_file_info(place)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(place, recursive=True))
        out |= {prefix + i.path: i.size for i in found if i.type == pafs.FileType.File and i.path.endswith(suffix)}
    return sorted(out.items())


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int, size: int) -> None:
        self.file, self.start, self.end, self.size = file, start, end, size


def scanned(part: Range, check: bool = True) -> Iterator[tuple[Block | None, list, int]]:
    """Blocks whose marker lies in a range, with offsets in the file; what a range holds is its bytes and those of the last block beyond them."""
    fs, place = store(part.file)
    longest = len(SYNC) + (1 << 16) + MOST + 4
    with fs.open_input_file(place) as f:
        f.seek(part.start)
        content = f.read(min(part.size, part.end + longest) - part.start)
    for block, records, gap in blocks(content, check, part.end - part.start):
        if block is not None:
            yield block._replace(offset=block.offset + part.start), records, gap
        else:
            yield None, [], gap - part.start if gap < 0 else gap


def _batch(file: str, block: Block, records: list) -> pa.RecordBatch:
    kinds, seqs, times, payloads = zip(*records, strict=True)
    n = len(records)
    columns = {"file": pa.array([file] * n), "record_type": pa.array(kinds), "seq": pa.array(seqs, pa.int64()), "ts_unix_ns": pa.array(times, pa.int64()), "payload": pa.array(payloads, pa.binary()), "block_offset": pa.array([block.offset] * n, pa.int64()), "position": pa.array(range(n), pa.int32())}
    return pa.RecordBatch.from_pydict(columns)


class _BlockReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.split, self.check = int(options.get("splitbytes", SPLIT)), options.get("check", "true") == "true"
        self.seq_max, self.ts_max = (int(options[k]) if k in options else None for k in ("seqmax", "tsmax"))
        self.what = options.get("what", "records")

    def partitions(self) -> list[Range]:
        return [Range(f, a, min(a + self.split, size), size) for f, size in listed(self.paths) for a in range(0, size, self.split)] or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator:
        if not partition.file:
            return
        if self.what != "records":
            yield from _summaries(partition)
            return
        for block, records, _ in scanned(partition, self.check):
            if block is None or not records or self.seq_max is not None and block.seq > self.seq_max or self.ts_max is not None and block.ts > self.ts_max:
                continue
            yield _batch(partition.file, block, records)


#: A block's place, size and bounds, what it holds, and how many records have no service or no severity at all; a marker without a good block has no length.
INDEX = """file string, file_size long, block_offset long, length long, packed long, plain long, records long, first_seq long, last_seq long, first_ts long, last_ts long,
min_seq long, max_seq long, min_ts long, max_ts long, types int, services array<string>, services_complete boolean, severities array<string>, severities_complete boolean, no_service long, no_severity long"""


def _bounded(values: set) -> tuple[list[str], bool]:
    """At most SUMMARY values, and whether they are all."""
    return (sorted(values), True) if len(values) <= SUMMARY else (sorted(values)[:SUMMARY], False)


def _summaries(part: Range) -> Iterator[tuple]:
    codes = {v: 1 << (k - 1) for k, v in TYPES.items()}
    for block, records, gap in scanned(part):
        if block is None:
            if gap < 0:
                yield (part.file, part.size, -1 - gap, *[None] * 19)
            continue
        mask, services, severities, no_service, no_severity = 0, set(), set(), 0, 0
        for kind, _, _, payload in records:
            mask |= codes[kind]
            own, levels = otlp.log_facts(payload) if kind == "logs" else (set(), set())
            services |= own
            severities |= levels
            no_service, no_severity = no_service + (not own), no_severity + (not levels)
        seqs, times = [r[1] for r in records] or [None], [r[2] for r in records] or [None]
        bounds = (seqs[0], seqs[-1], times[0], times[-1], *((min(seqs), max(seqs), min(times), max(times)) if records else [None] * 4))
        yield (part.file, part.size, block.offset, block.length, block.packed, block.plain, len(records), *bounds, mask, *_bounded(services), *_bounded(severities), no_service, no_severity)


def _source(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    register(spark)
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.format("recordblocks").options(paths=json.dumps(paths), **{k: str(v) for k, v in options.items() if v is not None}).load()


def read(spark: SparkSession, path: str | list[str], seq_max: int | None = None, ts_max: int | None = None, check: bool = True, split_bytes: int = SPLIT) -> DataFrame:
    """Records of all ``*.blk`` files under ``path``: file, record_type, seq, ts_unix_ns, payload, block_offset, position."""
    out = _source(spark, path, seqMax=seq_max, tsMax=ts_max, check=str(check).lower(), splitBytes=split_bytes)
    if seq_max is not None:
        out = out.filter(F.col("seq") <= seq_max)
    return out.filter(F.col("ts_unix_ns") <= ts_max) if ts_max is not None else out


def index(spark: SparkSession, path: str | list[str], split_bytes: int = SPLIT) -> DataFrame:
    """A row per good block (INDEX). Blocks and markers inside another good block, which only ranges see, are left out."""
    return _outermost(_source(spark, path, what="index", splitBytes=split_bytes)).filter("length is not null")


def _outermost(rows: DataFrame) -> DataFrame:
    end = F.col("block_offset") + F.coalesce("length", F.lit(0))
    rows = ranges.running(rows, ["file"], ["block_offset"], end, "before", "max", own=False)
    return rows.filter("before is null or block_offset >= before").drop("before")


def read_at(places: DataFrame) -> DataFrame:
    """Records of the blocks at (file, block_offset, length), such as rows of an index: no other bytes are read."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, place = store(file)
                with fs.open_input_file(place) as f:
                    f.seek(offset)
                    content = f.read(length)
                for block, records, _ in blocks(content):
                    if block is not None and records:
                        yield _batch(file, block._replace(offset=block.offset + offset), records)

    return places.select("file", "block_offset", "length").mapInArrow(rows, f"file string, {RECORD}")


def statistics(spark: SparkSession, path: str | list[str], split_bytes: int = SPLIT) -> DataFrame:
    """Per file: good and bad blocks, bytes skipped, records, packed and plain bytes, ratio in percent, records per block. Files without a marker have no row."""
    rows = _outermost(_source(spark, path, what="index", splitBytes=split_bytes))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = rows.groupBy("file").agg(
        F.count("length").alias("blocks_ok"),
        F.count_if(F.col("length").isNull()).alias("blocks_bad"),
        (F.max("file_size") - zero("length")).alias("bytes_skipped"),
        zero("records").alias("records"),
        zero("packed").alias("packed"),
        zero("plain").alias("plain"),
    )
    return out.withColumn("ratio_pct", F.round(F.try_divide(F.col("packed") * 100, "plain"), 1)).withColumn("per_block", F.round(F.try_divide("records", "blocks_ok"), 1))


def pack(records: list[tuple[str, int, int, bytes]], codec: int, alignment: int = 0) -> bytes:
    """One block of records whose sequence numbers and times are at least the first one's."""
    codes = {v: k for k, v in TYPES.items()}
    seq0, ts0 = records[0][1:3]
    raw = bytearray()
    for kind, seq, ts, payload in records:
        raw.append(codes[kind])
        for value in (seq - seq0, ts - ts0, len(payload)):
            while value > 127:
                raw.append(value & 127 | 128)
                value >>= 7
            raw.append(value)
        raw += payload
    name = CODECS[codec]
    body = pa.Codec(name).compress(bytes(raw), asbytes=True) if name else bytes(raw)
    fixed = HEAD.pack(VERSION, codec, 0, FIXED + EXTENSION, 0, len(raw), len(body), len(records), 0)[:-4]
    base = BASE.pack(seq0, ts0)
    head = fixed + crc32c(fixed + base).to_bytes(4, "little") + base
    out = SYNC + head + body + crc32c(head + body).to_bytes(4, "little")
    return out + bytes(-len(out) % alignment) if alignment else out


def cut(rows: Iterator[tuple[str, int, int, bytes]], target: int = TARGET) -> Iterator[list]:
    """Runs of records for one block each: up to ``target`` bytes, and cut early where sequence or time falls below the first."""
    now, size = [], 0
    for r in rows:
        need = len(r[3]) + 12
        if now and (size + need > target or r[1] < now[0][1] or r[2] < now[0][2]):
            yield now
            now, size = [], 0
        now.append(r)
        size += need
    if now:
        yield now


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.codec = {"none": 0, "lz4": 1, "zstd": 2}[options.get("codec", "lz4")]
        self.target, self.alignment = int(options.get("blocktarget", TARGET)), int(options.get("alignment", 0))
        self.job = uuid.uuid4().hex[:8]

    def write(self, iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        fs, place = store(self.path)
        fs.create_dir(place)
        name = f"{place}/part-{self.job}-{TaskContext.get().partitionId():05d}.blk"
        rows = ((r["record_type"], r["seq"], r["ts_unix_ns"], bytes(r["payload"] or b"")) for r in iterator)
        message = WriterCommitMessage()
        message.files = (f"{name}.{uuid.uuid4().hex}.tmp", name)
        with fs.open_output_stream(message.files[0]) as f:
            for run in cut(rows, self.target):
                f.write(pack(run, self.codec, self.alignment))
        return message

    def commit(self, messages) -> None:
        fs, place = store(self.path)
        if self.overwrite:
            for old in fs.get_file_info(pafs.FileSelector(place)):
                if old.path.endswith(".blk"):
                    fs.delete_file(old.path)
        for m in messages:
            if m is not None:
                fs.move(*m.files)

    def abort(self, messages) -> None:
        fs, _ = store(self.path)
        for m in messages:
            if m is not None and fs.get_file_info(m.files[0]).type == pafs.FileType.File:
                fs.delete_file(m.files[0])


class BlockFiles(DataSource):
    """``recordblocks``: read with options path or paths (a JSON list), splitBytes, seqMax, tsMax, check, what (records, index); written with
    options codec (none, lz4, zstd), blockTarget, alignment. The folder must be one all executors share."""

    @classmethod
    def name(cls) -> str:
        return "recordblocks"

    def schema(self) -> str:
        return INDEX if self.options.get("what") == "index" else f"file string, {RECORD}"

    def reader(self, schema) -> DataSourceReader:
        return _BlockReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BlockFiles)
