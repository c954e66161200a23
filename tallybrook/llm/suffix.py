"""Removal of long repeated byte strings: merging of shard Burrows-Wheeler transforms.

Strings of ``length`` bytes can only be equal if their least hashed 32-byte gram is: each belongs to the bucket of that value.
Consecutive strings of one bucket are one segment of text; buckets that hold one gram alone can't hold a repeat and go no
further. Equal segments are collapsed with their count. Two lengths can be asked for at once: buckets are those of the shorter
strings, and a segment goes on to the end of the longer strings that start in it.

Of a segment only what it shares with others around its bucket's gram is merged (see ``extents``); one that occurs twice or more
as a whole needs no merging for its own sake, since all its strings repeat.

The segments of some buckets at a time are dealt to shards. Each shard's suffixes are sorted once, which gives its transform.
Transforms are merged by refining how their rows interleave: from an interleave sorted to depth h, stepping each row d <= h symbols
on through its transform and dealing the rows of a block by the blocks they come to gives the order to depth h + d, and shows where
common prefixes end. Dealing sorts short keys: all rows by their first four symbols once, then the rows of blocks still open by
(block, block stepped to), so it is prefix doubling over the union of the shards' rows; texts of suffixes are not compared again. Blocks that still hold several rows at depth ``length`` are the repeated
intervals; the shards' suffix arrays turn them into spans of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybrook.llm.common import batch_of, bit_filter, released, rows_of, shielded, staged, unstage

#: Bytes of a gram, of a shard, and of the segments that are merged together; a bucket above LARGE takes ``_large``'s way.
GRAM, SHARD, TOGETHER, LARGE = 32, 1 << 18, 1 << 20, 6 << 20
#: Ends a segment; no UTF-8 text holds it, and it sorts last.
STOP = 0xFF
U = np.uint64


def grams(b: np.ndarray) -> np.ndarray:
    """64-bit hashes of all GRAM-byte grams."""
    h, size, base = b.astype(U) + U(1), 1, 0x9E3779B97F4A7C15
    h *= U(0xD6E8FEB86659FD93)
    while size < GRAM:
        h = h[:-size] * U(base) + h[size:]
        base, size = base * base & (1 << 64) - 1, 2 * size
    h ^= h >> U(31)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(29)
    return h


def sliding(h: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """Least or greatest of each ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        h = best(h[:-size], h[size:])
        size *= 2
    return best(h[: len(h) - (width - size)], h[width - size :]) if size < width else h


def windows(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Gram hashes, and the least of each string of ``length`` bytes; None for a shorter text."""
    if len(raw) < length:
        return None
    h = grams(np.frombuffer(raw, np.uint8))
    return h, sliding(h, length - GRAM + 1, np.minimum)


def anchors(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct least values of a text's strings, and at how many places each is a least gram."""
    got = windows(raw, length)
    if got is None:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h, m = got
    width = length - GRAM + 1
    edge = np.zeros(width - 1, U)
    at = h == sliding(np.concatenate([edge, m, edge]), width, np.maximum)
    return np.unique(h[at], return_counts=True)


def segments(raw: bytes, length: int, wanted: np.ndarray) -> Iterator[tuple[np.uint64, int, int]]:
    """(value, first, last + 1) of the starts of each run of strings whose value is among the sorted ``wanted``."""
    got = windows(raw, length)
    if got is None or not len(wanted):
        return
    m = got[1]
    starts = np.concatenate([[0], np.flatnonzero(m[1:] != m[:-1]) + 1])
    ends = np.concatenate([starts[1:], [len(m)]])
    for i in np.flatnonzero(np.isin(m[starts], wanted)):
        yield m[starts[i]], int(starts[i]), int(ends[i])


def _begun(symbols: np.ndarray, forth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of rows by their first four symbols (a block's number is the place of its first row), and the rows of blocks of several, in order.

    ``forth`` is the row one symbol on. From a segment's end on nothing counts, and what comes to it is a block of its own.
    """
    key, low = symbols.astype(U), U(STOP)
    for width in (1, 2):
        rest = np.where(key & U(STOP) == STOP, low, key[forth])
        key = (key << U(8 * width)) | rest
        low, forth = low | low << U(8 * width), forth[forth]
    p = (key << U(31)) | np.arange(len(key), dtype=U)
    p.sort()
    order = (p & U((1 << 31) - 1)).astype(np.int32)
    p >>= U(31)
    edge = np.ones(len(p) + 1, bool)
    edge[1:-1] = (p[1:] != p[:-1]) | (p[1:] & U(STOP) == STOP)
    block = np.empty(len(p), np.int32)
    block[order] = np.maximum.accumulate(np.where(edge[:-1], np.arange(len(p), dtype=np.int32), 0))
    return block, order[~(edge[:-1] & edge[1:])]


def _refined(block: np.ndarray, live: np.ndarray, beyond: np.ndarray) -> np.ndarray:
    """Deals the ``live`` rows, whole blocks of several, by the blocks ``beyond``; gives those that still share a block."""
    if len(block) < 1 << 21:  # block, block beyond and row in one number
        p = (block[live].astype(np.int64) << 42) | (beyond.astype(np.int64) << 21) | np.arange(len(live))
        p.sort()
        live, p = live[p & (1 << 21) - 1], p >> 21
        old = p >> 21
    else:
        p = (block[live].astype(np.int64) << 32) | beyond
        o = np.argsort(p)
        live, p = live[o], p[o]
        old = p >> 32
    edge = np.ones(len(p) + 1, bool)
    np.not_equal(p[1:], p[:-1], out=edge[1:-1])
    first = np.flatnonzero(edge[:-1])
    old = old[first]
    begin = np.maximum.accumulate(np.where(np.diff(old, prepend=-1) != 0, first, 0))  # of the old block among the rows
    block[live] = np.repeat((old + first - begin).astype(np.int32), np.diff(first, append=len(p)))
    return live[~(edge[:-1] & edge[1:])]


class Shard:
    """Sorted suffixes of some segments: suffix array and Burrows-Wheeler transform. Each segment's end is a symbol of its own."""

    def __init__(self, parts: list[bytes]) -> None:
        stop = bytes([STOP])
        self.text = t = np.frombuffer(stop.join(parts) + stop, np.uint8)
        n = len(t)
        rank, live = _begun(t, np.minimum(np.arange(1, n + 1, dtype=np.int32), n - 1))
        depth = 4
        while len(live):
            live = _refined(rank, live, rank[live + depth])
            depth *= 2
        self.suffixes = np.empty(n, np.int32)
        self.suffixes[rank] = np.arange(n, dtype=np.int32)
        self.transform = t[self.suffixes - 1]

    def forth(self) -> np.ndarray:
        """For each row the row of the suffix one symbol shorter, from the transform alone."""
        return np.argsort(self.transform, kind="stable").astype(np.int32)


def merge(shards: list[Shard], lengths: list[int]) -> Iterator[np.ndarray]:
    """Interleaves the shards' rows to rising depths; for each the block of each row, rows of all shards one after the other."""
    offsets = np.cumsum([0, *(len(s.transform) for s in shards)])
    n = int(offsets[-1])
    forth = np.concatenate([s.forth() + np.int32(o) for s, o in zip(shards, offsets, strict=False)])
    block, live = _begun(np.concatenate([np.sort(s.transform, kind="stable") for s in shards]), forth)
    steps, depth = [], 4
    for length in lengths:
        while depth < length:
            steps.append((length, min(depth, length - depth)))
            depth += steps[-1][1]
    powers = {1: forth}

    def power(p: int) -> np.ndarray:
        if p not in powers:
            powers[p] = power(p // 2)[power(p // 2)]
        return powers[p]

    for length in lengths:
        while steps and steps[0][0] == length:
            step = steps.pop(0)[1]
            to = live
            for p in (1 << i for i in range(step.bit_length()) if step >> i & 1):
                to = power(p)[to]
            live = _refined(block, live, block[to])
            for p in [p for p in powers if 2 * p in powers and not any(x & p for _, x in steps)]:
                del powers[p]  # no later step is made of it
        yield block


def repeats(parts: list[bytes], runs: list[int], counts: list[int], lengths: list[int]) -> Iterator[list[tuple[int, list[tuple[int, int]]]]]:
    """For each of rising lengths the (part, covered spans) of the parts that hold strings of so many bytes which occur twice or more.

    Only strings that start at the first ``runs`` bytes of a part count, each as often as the part does by ``counts``.
    """
    shards, size, begin = [], 0, 0
    for i, p in enumerate(parts):
        size += len(p) + 1
        if size >= SHARD or i == len(parts) - 1:
            shards.append(Shard(parts[begin : i + 1]))
            begin, size = i + 1, 0
    sizes = np.array([len(p) for p in parts])
    starts = np.cumsum([0, *(sizes[:-1] + 1)])
    offsets = np.cumsum([0, *(len(s.text) for s in shards)])
    at = np.concatenate([s.suffixes + np.int32(o) for s, o in zip(shards, offsets, strict=False)])
    part = np.repeat(np.arange(len(parts), dtype=np.int32), sizes + 1)[at]
    place, weight = at - starts[part], np.asarray(counts, float)[part]
    counted = place < np.asarray(runs)[part]
    for length, block in zip(lengths, merge(shards, lengths), strict=True):
        fits = counted & (sizes[part] - place >= length)
        total = np.bincount(block[fits], weights=weight[fits], minlength=len(block))
        hit = np.zeros(len(block), bool)
        hit[at[fits & (total[block] > 1)]] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
        spans: dict[int, list[tuple[int, int]]] = {}
        owner = np.searchsorted(starts, edges[::2], side="right") - 1
        for a, b, o in zip(edges[::2], edges[1::2], owner, strict=True):
            spans.setdefault(int(o), []).append((int(a - starts[o]), int(b - starts[o]) + length - 1))
        yield list(spans.items())


def extents(parts: list[bytes], values: list[int], length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of the bytes of each segment of whole buckets that strings which two segments share, or one holds twice, are within.

    Where the bucket's gram stands once in each of its segments, equal strings of ``length`` bytes lie at equal distances from it. So they
    share all grams at multiples of GRAM bytes from it that they hold, without a gap: segments are told apart gram by gram, outwards from it.
    """
    v = np.array(values, np.int64).view(U)
    bucket = np.cumsum(np.diff(v, prepend=v[:1]) != 0)
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    h = grams(np.frombuffer(b"".join(parts), np.uint8))
    owner = np.repeat(np.arange(len(parts)), sizes)[: len(h)]
    at = np.flatnonzero((h == v[owner]) & (np.arange(len(h)) + GRAM <= ends[owner]))
    anchor = np.zeros(len(parts), np.int64)
    anchor[owner[at]] = at
    once = np.bincount(owner[at], minlength=len(parts)) == 1
    unsure = (np.bincount(bucket, weights=~once) > 0)[bucket]
    shared = []
    for side in (-GRAM, GRAM):
        far, who, group, step = np.zeros(len(parts), np.int64), np.flatnonzero(~unsure), bucket[~unsure], 0
        while True:
            alike = np.bincount(group, minlength=1)[group] > 1
            who, group = who[alike], group[alike]
            far[who] = step
            place = anchor[who] + side * (step + 1)
            inside = (place >= starts[who]) & (place + GRAM <= ends[who])
            who, group, step = who[inside], group[inside], step + 1
            if not len(who):
                break
            group = np.unique((h[place[inside]] >> U(20)) ^ (group.astype(U) << U(44)), return_inverse=True)[1]
        shared.append(far)
    first, last = anchor - GRAM * (shared[0] + 1) + 1, anchor + GRAM * (shared[1] + 2) - 1
    return np.where(unsure, 0, np.maximum(first - starts, 0)), np.where(unsure, sizes, np.minimum(last - starts, sizes))


def promising(parts: list[bytes], values: list[int], counts: list[int], length: int) -> np.ndarray:
    """Which segments of whole buckets may hold a string of ``length`` bytes that occurs twice; the others certainly don't."""
    first, last = extents(parts, values, length)
    return (last - first >= length) | (np.array(counts) > 1)


def _merged(lengths: list[int]):
    """Reads (v, s, seg, run, n) sorted by v, merges whole buckets together, gives (s, which length, spans)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, parts, runs, counts, values, size, now = [], [], [], [], [], 0, None

        def flush() -> pd.DataFrame:
            got = []
            if parts:
                # of a segment that occurs twice all strings do: it is merged for what others share with it
                for key, p, own, n in zip(keys, parts, runs, counts, strict=True):
                    if n > 1:
                        got += [(key, which, [{"start": 0, "end": min(own - 1 + x, len(p))}]) for which, x in enumerate(lengths) if len(p) >= x]
                first, last = extents(parts, values, lengths[0])
                v, many = np.array(values), np.array(counts) > 1
                lone = np.diff(v, prepend=~v[0]) != 0
                lone[:-1] &= lone[1:]
                good = np.flatnonzero((last - first >= lengths[0]) & (first < np.array(runs)) & ~(lone & many)).tolist()
                cut = [parts[i][first[i] : last[i]] for i in good]
                found = repeats(cut, [runs[i] - int(first[i]) for i in good], [counts[i] for i in good], lengths) if good else []
                for which, each in enumerate(found):
                    for j, spans in each:
                        i = good[j]
                        if not many[i]:
                            got.append((keys[i], which, [{"start": a + int(first[i]), "end": b + int(first[i])} for a, b in spans]))
            for x in (keys, parts, runs, counts, values):
                x.clear()
            return pd.DataFrame(got, columns=["s", "which", "spans"])

        for b in batches:
            for v, s, seg, own, n in zip(b["v"], b["s"], b["seg"], b["run"], b["n"], strict=True):
                if v != now and size >= TOGETHER:
                    yield flush()
                    size = 0
                now = v
                keys.append(s)
                values.append(v)
                parts.append(bytes(seg))
                runs.append(own)
                counts.append(n)
                size += len(seg)
        yield flush()

    return run


def _large(segs: DataFrame, length: int) -> DataFrame:
    """(s, spans) for segments of buckets too large to merge in one place: hashes of all their strings are grouped instead."""
    import xxhash

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s, seg, own, n in zip(b["s"], b["seg"], b["run"], b["n"], strict=True):
                places: dict[bytes, list[int]] = {}
                for i in range(min(own, len(seg) - length + 1)):
                    places.setdefault(xxhash.xxh3_128_digest(seg[i : i + length]), []).append(i)
                if places:
                    yield pd.DataFrame({"w": list(places), "s": [s] * len(places), "n": n, "at": list(places.values())})

    strings = staged(segs.select("s", "seg", "run", "n").repartition("s").mapInPandas(hashed, "w binary, s binary, n long, at array<int>"), "strings")
    often = strings.groupBy("w").agg(F.sum(F.col("n") * F.size("at")).alias("t")).filter("t > 1").select("w")
    hits = strings.join(often, "w").groupBy("s").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("at"))
    return hits.select("s", F.transform("at", lambda a: F.struct(a.alias("start"), (a + length).alias("end"))).alias("spans"))


def merge_spans(spans: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_SPANS = "array<struct<start:int,end:int>>"


def repeated(docs: DataFrame, text: str = "text", length: int = 400, large: int = LARGE, shorter: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``repeat_spans``, in two tables: rows that may have spans, and rows that have none.

    ``repeat_spans`` are the maximal runs of bytes (of the UTF-8 text) covered by strings of ``length`` bytes that start at two or
    more places in all texts, the same text included. With ``shorter``, a smaller length, ``passage_spans`` are the same for that
    length. Rows with equal texts repeat each other. Null, empty and shorter texts have no spans; an empty table gives no rows. All
    other columns are passed on; columns ``repeat_spans`` and ``passage_spans`` are replaced.
    """
    lengths = [length] if shorter is None else [shorter, length]
    names = ["repeat_spans"] if shorter is None else ["passage_spans", "repeat_spans"]
    least = lengths[0]
    own = "__repeat_hash"
    docs, back = shielded(docs.drop("repeat_spans", "passage_spans"))
    docs = docs.withColumn(own, F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    rows = docs.select(F.col(own).alias("h"), F.col(text).alias("t")).filter(F.octet_length("t") >= least)

    found_at = pa.schema([("h", pa.binary()), ("v", pa.list_(pa.int64())), ("n", pa.list_(pa.int32()))])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, t in rows_of(b):
                v, n = anchors(t.encode(), least)
                out.append((h, v.view(np.int64), n.astype(np.int32)))
            yield batch_of(out, found_at)

    copies = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.first(F.octet_length("t")).alias("size")).filter("n > 1")
    copies = copies.select("h", F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.lit(x).alias("need")) for i, x in enumerate(lengths)])).alias("x"), "size").filter("size >= x.need")
    copies = copies.select("h", "x.which", F.array(F.struct(F.lit(0).alias("start"), F.col("size").alias("end"))).cast(_SPANS).alias("spans"))
    places = rows.mapInArrow(released(measured), "h binary, v array<long>, n array<int>").select("h", F.explode(F.arrays_zip("v", "n")).alias("x")).select("h", "x.v", "x.n")
    shared = places.groupBy("v").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.max("n").alias("m")).filter("a <> b or m > 1").select("v")
    wanted = staged(places.join(shared, "v").groupBy("h").agg(F.collect_set("v").alias("wanted")), "anchors")

    pieces = pa.schema([("v", pa.int64()), ("s", pa.binary()), ("seg", pa.binary()), ("run", pa.int32()), ("h", pa.binary()), ("start", pa.int32())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        last = None
        for b in batches:
            out, size = [], 0
            for h, t, w in rows_of(b):
                if h == last:
                    continue
                last, raw = h, t.encode()
                for v, start, end in segments(raw, least, np.sort(np.asarray(w, np.int64).view(U))):
                    seg = raw[start : end + length - 1]
                    out.append((v.view(np.int64), hashlib.md5(seg + (end - start).to_bytes(8, "little")).digest(), seg, end - start, h, start))
                    size += len(seg)
                if size >= TOGETHER:
                    yield batch_of(out, pieces)
                    out, size = [], 0
            yield batch_of(out, pieces)

    texts = rows.filter(bit_filter(wanted, "h")).join(wanted, "h").sortWithinPartitions("h")
    segs = staged(texts.select("h", "t", "wanted").mapInArrow(released(cut), "v long, s binary, seg binary, run int, h binary, start int"), "segments")
    distinct = staged(segs.groupBy("v", "s").agg(F.first("seg").alias("seg"), F.first("run").alias("run"), F.count(F.lit(1)).alias("n")), "distinct")
    sizes = staged(distinct.groupBy("v").agg(F.sum(F.octet_length("seg") + 1).alias("bytes")).filter(F.col("bytes") > large).select("v"), "large-buckets")
    ordinary = distinct
    if not sizes.isEmpty():
        ordinary = distinct.join(sizes, "v", "left_anti")
    found = ordinary.repartition("v").sortWithinPartitions("v", "s").mapInPandas(released(_merged(lengths)), f"s binary, which int, spans {_SPANS}")
    if not sizes.isEmpty():
        for i, x in enumerate(lengths):
            found = found.unionByName(_large(distinct.join(sizes, "v"), x).withColumn("which", F.lit(i)))
    found = staged(found, "repeats")
    spans = segs.select("s", "h", "start").join(found, "s").select("h", "which", F.transform("spans", lambda x: F.struct((x["start"] + F.col("start")).cast("int").alias("start"), (x["end"] + F.col("start")).cast("int").alias("end"))).alias("spans"))

    @F.pandas_udf(_SPANS)
    def joined(many: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in merge_spans((x["start"], x["end"]) for x in s)] for s in many])

    spans = spans.unionByName(copies).groupBy("h").agg(*[F.flatten(F.collect_list(F.when(F.col("which") == i, F.col("spans")))).alias(x) for i, x in enumerate(names)])
    spans = staged(spans.select(F.col("h").alias(own), *[joined(x).alias(x) for x in names]), "spans")
    for done in (segs, distinct, wanted, found, sizes):
        unstage(done)
    may = "__repeat_may"
    told = docs.withColumn(may, bit_filter(spans, own))
    none = F.array().cast(_SPANS)
    with_spans = told.filter(may).join(spans, own, "left").withColumns({x: F.coalesce(x, none) for x in names}).drop(may, own)
    return with_spans.withColumnsRenamed(back), told.filter(~F.col(may)).drop(may, own).withColumns({x: none for x in names}).withColumnsRenamed(back)


def _outside(text: pd.Series, spans: pd.Series) -> list[bytes]:
    out = []
    for t, s in zip(text, spans, strict=True):
        raw, at, parts = (t or "").encode(), 0, []
        for x in s:
            parts.append(raw[at : x["start"]])
            at = x["end"]
        out.append(b"".join([*parts, raw[at:]]))
    return out


@F.pandas_udf(T.BinaryType())
def kept(text: pd.Series, spans: pd.Series) -> pd.Series:
    """The bytes of each text outside its spans."""
    return pd.Series(_outside(text, spans))


@F.pandas_udf(T.StringType())
def kept_text(text: pd.Series, spans: pd.Series) -> pd.Series:
    """The same as text, without what is left of characters that a span cuts in two."""
    return pd.Series([raw.decode(errors="ignore") for raw in _outside(text, spans)])


def whole_words(raw: bytes, a: int, b: int) -> int:
    """Words of a span; those that its ends cut don't count."""
    while a and a < b and not raw[a - 1 : a].isspace():
        a += 1
    n = len(raw[a:b].split())
    return n - (n > 0 and b < len(raw) and not raw[b - 1 : b].isspace() and not raw[b : b + 1].isspace())


@F.pandas_udf(T.LongType())
def longest_run(text: pd.Series, spans: pd.Series) -> pd.Series:
    """Words of the span that holds most; 0 without spans. Words that a span cuts don't count."""
    return pd.Series([max((whole_words((t or "").encode(), x["start"], x["end"]) for x in s), default=0) for t, s in zip(text, spans, strict=True)])


def with_passages(text: str, spans: str, passages: str, words: int) -> Column:
    """``spans`` and those of ``passages`` that hold over ``words`` whole words, as maximal runs."""

    @F.pandas_udf(_SPANS)
    def joined(texts: pd.Series, own: pd.Series, more: pd.Series) -> pd.Series:
        out = []
        for t, s, p in zip(texts, own, more, strict=True):
            raw = (t or "").encode()
            all_spans = [(x["start"], x["end"]) for x in s] + [(x["start"], x["end"]) for x in p if whole_words(raw, x["start"], x["end"]) > words]
            out.append([{"start": a, "end": b} for a, b in merge_spans(all_spans)])
        return pd.Series(out)

    return joined(text, spans, passages)
