"""Replay of block files as a stream, with resumption, bounded admission, and draining of what is committed.

An offset holds, for each file, the block and the record in it up to which records have been taken, so that a file is read for what it
holds whatever its numbers are. The driver lists files and, where admission is bounded, walks no more records than the bound; records are read in
tasks, each a range of a file's bytes. Spark commits a batch only when all batches before it are written, so what is committed has no gaps.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tallybrook.plans.model import RECORD
from tallybrook.sources.blocks import MOST, SPLIT, Range, listed, scanned, store

#: What happens to a backlog beyond the bound: it waits, is an error, or its newest records are dropped.
POLICIES = ("block", "disconnect", "drop-newest")
#: Bytes that the driver walks at a time to find where a bound is reached.
STEP = 1 << 20


class Span(InputPartition):
    """A range of a file, and the places (block, record) from which, up to which, and up to which with payload, records are taken."""

    def __init__(self, part: Range, start: tuple[int, int], stop: tuple[int, int], admitted: tuple[int, int], after: int) -> None:
        self.part, self.start, self.stop, self.admitted, self.after = part, start, stop, admitted, after


def reconciled(saved: dict, stream: str | None, last: int | None) -> dict:
    """Where to resume: ``saved`` (stream, after, files), or the beginning where the saved identity isn't ``stream``, or where none was saved
    and the source's ``last`` number is below the saved one."""
    known, after = saved.get("stream"), saved.get("after", -1)
    again = known != stream if known is not None else after > 0 and last is not None and 0 < last < after
    return {"stream": stream, "after": -1 if again else after, "files": {} if again else saved.get("files", {})}


def last_number(file: str, size: int) -> int | None:
    """The highest number of a file's last good block within its last 16 MB or so."""
    for width in (STEP, 2 * MOST):
        found = [r[1] for _, records, _ in scanned(Range(file, max(0, size - width), size, size)) for r in records[-1:]]
        if found:
            return max(found)
    return None


def admitted(files: dict, sizes: dict[str, int], limit: int) -> tuple[dict, bool]:
    """Places after ``limit`` more records, in order of path and place, and whether records are left."""
    out, left = {}, limit
    for file, size in sorted(sizes.items()):
        first, skip = files.get(file, (0, 0))
        at = first
        while at < size:
            end = min(at + STEP, size)
            for block, records, _ in scanned(Range(file, at, end, size)):
                if block is None or block.offset < first:
                    continue
                done = skip if block.offset == first else 0
                if len(records) - done > left:
                    rest = {f: files[f] for f in sizes if f > file and f in files}
                    return out | {file: [block.offset, done + left]} | rest, True
                left -= len(records) - done
                end = max(end, block.offset + block.length)
            at = end
        out[file] = [size, 0]
    return out, False


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.after, self.drain = options["path"], int(options.get("after", -1)), options.get("drain", "false") == "true"
        self.split, self.state, self.identity = int(options.get("splitbytes", SPLIT)), options.get("state"), options.get("identity")
        self.limit, self.policy = int(options["maxrecords"]) if "maxrecords" in options else None, options.get("policy", "block")
        if self.policy not in POLICIES:
            raise ValueError(f"policy must be one of {', '.join(POLICIES)}")
        if self.limit is not None and (self.limit < 1 or not self.state):
            raise ValueError("maxRecords must be positive and needs state, a file that all runs share")
        self.saved = self._load()
        self.at = self.saved.get("planned")

    def _load(self) -> dict:
        if not self.state:
            return {}
        fs, place = store(self.state)
        if fs.get_file_info(place).type != pafs.FileType.File:
            return {}
        with fs.open_input_file(place) as f:
            return json.loads(f.read())

    def _save(self, **values: dict) -> None:
        if self.state:
            self.saved |= values
            fs, place = store(self.state)
            fs.create_dir(place.rsplit("/", 1)[0])
            with fs.open_output_stream(f"{place}.tmp") as f:
                f.write(json.dumps(self.saved).encode())
            fs.move(f"{place}.tmp", place)

    def _stream(self) -> str | None:
        """The identity given, or the text of the folder's file ``_stream``; null without either."""
        if self.identity is not None:
            return self.identity
        fs, place = store(self.path)
        info = fs.get_file_info(f"{place}/_stream")
        if info.type != pafs.FileType.File:
            return None
        with fs.open_input_file(info.path) as f:
            return f.read().decode().strip()

    def initialOffset(self) -> dict:
        saved, stream = self.saved.get("committed") or {"after": self.after}, self._stream()
        last = None
        if saved.get("stream") is None and saved.get("after", -1) > 0:
            last = max((n for f in listed([self.path]) if (n := last_number(*f)) is not None), default=None)
        self.at = reconciled(saved, stream, last)
        return self.at

    def latestOffset(self) -> dict:
        at, stream, sizes = self.at or self.initialOffset(), self._stream(), dict(listed([self.path]))
        if at["stream"] != stream:
            at = reconciled(at, stream, None)
        files, ends, over = at["files"], {f: [size, 0] for f, size in sizes.items()}, False
        places = ends
        if self.limit is not None:
            places, over = admitted(files, sizes, self.limit)
        if over and self.policy == "disconnect":
            raise RuntimeError(f"more than {self.limit} records wait to be taken")
        if over and self.policy == "block":
            ends = places
        if at is not self.at or any(files.get(f) != end for f, end in ends.items()):
            self.at = {"stream": stream, "after": at["after"], "files": ends}
            if ends is not places:
                self.at["admitted"] = {f: places.get(f, [0, 0]) for f in ends if places.get(f) != ends[f]}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Span]:
        self.at = end
        self._save(planned=end)
        taken, sizes, out = start["files"] if start["stream"] == end["stream"] else {}, dict(listed([self.path])), []
        for file, stop in end["files"].items():
            begin = taken.get(file, [0, 0])
            upto = stop[0] + (stop[1] > 0)
            full = tuple(end.get("admitted", {}).get(file, stop))
            if begin < stop:
                ranges = (Range(file, a, min(a + self.split, upto), max(sizes.get(file, 0), stop[0])) for a in range(begin[0], upto, self.split))
                out += [Span(r, tuple(begin), tuple(stop), full, end["after"]) for r in ranges]
        return out

    def read(self, partition: Span) -> Iterator[tuple]:
        for block, records, _ in scanned(partition.part):
            if block is not None:
                for i, (kind, seq, ts, payload) in enumerate(records):
                    place = (block.offset, i)
                    if partition.start <= place < partition.stop and seq > partition.after:
                        taken = place < partition.admitted
                        yield kind, seq, ts, payload if taken else None, block.offset, i, taken

    def commit(self, end: dict) -> None:
        self._save(committed=end)
        if self.drain:
            sizes = dict(listed([self.path]))
            for file, place in end["files"].items():
                if place == [sizes.get(file), 0]:
                    fs, name = store(file)
                    fs.delete_file(name)


class Replay(DataSource):
    """``spark.readStream.format("recordreplay")``: records, and ``admitted``, false for those that were dropped, which come without payload.

    Options: path (of any store that block files are read from); after, a sequence number above which records are taken; drain, which deletes files when all
    their records are committed; splitBytes; state, a file outside the folder that keeps what is committed for queries with a new checkpoint; identity of
    the stream, else the text of ``_stream`` in the folder: where it changes, all is read from the beginning. maxRecords bounds what one
    trigger takes (one run, with availableNow), by the order of paths and places; policy says what happens to the rest: block (later triggers
    take it), disconnect (the query fails), drop-newest. Files come whole, by a rename, or grow by whole blocks.
    """

    @classmethod
    def name(cls) -> str:
        return "recordreplay"

    def schema(self) -> str:
        return f"{RECORD}, admitted boolean"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def drops(batch: DataFrame) -> DataFrame:
    """(record_type, dropped): how many records of each kind a batch dropped."""
    return batch.filter(~F.col("admitted")).groupBy("record_type").agg(F.count(F.lit(1)).alias("dropped"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Replay)
