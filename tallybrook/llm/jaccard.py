"""N-gram Jaccard join by grouped prefixes.

Shingles are put in one global order, rarest first. Two sets of Jaccard similarity t or more share a shingle among the first
n - ceil(t n) + 1 of each, so a set whose first ones occur nowhere else has no partner. Counts of all shingles come from one shuffle:
tasks cut their sets into ranges of hashes, a range's shingles of all sets meet in one group, and what occurs twice or more goes
back to its set with its count, in one row for many sets. Documents with equal size and prefix are one group; groups that share a prefix shingle are
candidates; members are verified on whole texts.

For components not every candidate needs checking. A first round checks the members of a group against the group's first member,
and the groups of a shingle against a few of them: the one with the smallest share of shingles of its own, which is likely what the
others were edited from, and some chosen by hash. Then every pair of members that the links found so far have not joined is
verified, but for those that can't be alike: by sizes, by shingles of their own, by the places where they meet in the order (first by classes
of members with about the same of these, of which a list has a bounded number, so that members that can't be alike are never paired), and by
bitmaps of what they share with any set, whose differing bits each stand for a differing shingle. So no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.llm.common import batch_of, bit_filter, released, rows_of, staged, unstage
from tallybrook.llm.components import connected

#: Groups of a shingle that all its others are checked against in the first round.
CENTRES = 4
#: Texts that are checked against one copy of another.
CHUNK = 256
#: Words a task remembers the hashes of; texts it remembers, to count copies once; shingles it cuts into ranges at a time.
VOCABULARY, SEEN, TOGETHER = 200_000, 200_000, 400_000
#: Shingles a range aims at; bytes of text for each; least number of ranges; bits of a hash after those that choose the range.
RANGE, BYTES, RANGES, REST = 500_000, 6, 64, 40
#: 64-bit words of a bitmap; sets whose prefixes are made together.
BITMAP, ROWS = 16, 2_000
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


class Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > VOCABULARY:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def grams(t: np.ndarray, width: int) -> np.ndarray:
    n = len(t)
    w = min(n, width)
    h = np.full(n - w + 1, w, np.uint64)
    for i in range(w):
        h = (h ^ t[i : n - w + 1 + i]) * np.uint64(MIX[i % len(MIX)])
        h ^= h >> np.uint64(29)
    return h


def shingles(text: str | None, known: Words, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word ``width``-grams; of the whole sequence where it is shorter; none without words."""
    tokens = (text or "").encode().lower().split()
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    return np.unique(grams(np.fromiter(map(known.__getitem__, tokens), np.uint64, n), width))


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def ranks(counts: np.ndarray) -> np.ndarray:
    """Eight bits that never fall as a count rises."""
    return np.minimum(255, np.where(counts < 64, counts, 64 + 16 * (np.log2(np.maximum(counts, 1)) - 6))).astype(np.uint64)


_RANGED = "range int, id long, key long, n long, set_key binary, rest binary, keys binary, many binary"
_RANGED_ARROW = pa.schema([("range", pa.int32()), ("id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), *[(c, pa.binary()) for c in ("set_key", "rest", "keys", "many")]])
_COUNTED = "id long, key long, n long, set_key binary, part int, keys binary, many binary, tokens binary"
#: Ranges for each part that sets are dealt to when their tokens are put together, and the least number of parts.
DEALT, PARTS = 16, 64


def flat(a: np.ndarray) -> bytes:
    """64-bit or 32-bit numbers byte place by byte place, since their high bytes are alike and are packed to little then."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()


def unflat(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    h = keys.view(np.uint64) * np.uint64(MIX[1])
    return ((h ^ (h >> np.uint64(32))) % np.uint64(parts)).astype(np.int32)


def _cut(width: int, bits: int):
    """Sets of texts (key, id, t): a row for each text, and for each range and some texts one with their hashes there."""

    def cut(texts: list[np.ndarray], keys: list[int]) -> pa.RecordBatch:
        every = np.concatenate(texts)
        number = (every >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
        order = np.argsort(number, kind="stable")
        number, owner = number[order], np.repeat(np.arange(len(texts)), list(map(len, texts)))[order]
        rest = (every[order] >> np.uint64(64 - bits - REST)).view(np.uint8).reshape(-1, 8)[:, : REST // 8]
        bounds = np.flatnonzero(np.diff(number.astype(np.int64), prepend=-1, append=-1))
        names, out = np.array(keys, np.int64), []
        for a, b in zip(bounds, bounds[1:]):
            runs = np.flatnonzero(np.diff(owner[a:b], prepend=-1))
            many = np.diff(runs, append=b - a).astype(np.uint32)
            out.append((int(number[a]), 0, 0, 0, None, rest[a:b].tobytes(), flat(names[owner[a:b][runs]]), flat(many)))
        return batch_of(out, _RANGED_ARROW)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, texts, keys, size = Words(), set(), [], [], 0
        for b in batches:
            rows = []
            for key, doc, t in rows_of(b):
                s = shingles(t, known, width)
                name = xxhash.xxh3_128_digest(s.tobytes())
                rows.append((key % (1 << bits), doc, key, len(s), name if len(s) else None, None, None, None))
                if len(s) and name not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(name)
                    texts.append(s)
                    keys.append(key)
                    size += len(s)
                if size >= TOGETHER:
                    yield cut(texts, keys)
                    texts, keys, size = [], [], 0
            yield batch_of(rows, _RANGED_ARROW)
        if texts:
            yield cut(texts, keys)

    return measured


def _counted(bits: int, parts: int):
    """Reads rows of ``_cut`` sorted by range: passes texts on with their sets' part, and gives for each range and part the tokens of its sets that occur twice or more.

    A part's rows are as many as there are ranges, whatever its number of sets. A token is an unsigned number: the rank of its count, then its hash; so tokens sort in the global order.
    """

    columns = _COUNTED.replace(",", "").split()[::2]

    def tokens(number: int, rest: list[bytes], keys: list[bytes], many: list[bytes]) -> pd.DataFrame:
        raw = np.frombuffer(b"".join(rest), np.uint8).reshape(-1, REST // 8)
        h = np.zeros((len(raw), 8), np.uint8)
        h[:, : REST // 8] = raw
        h = h.view(np.uint64).ravel()
        own = np.repeat(np.concatenate([unflat(x, np.int64) for x in keys]), np.concatenate([unflat(x, np.uint32) for x in many]))
        order = np.argsort(h)
        h, own = h[order], own[order]
        twice = np.zeros(len(h), bool)
        twice[1:] = h[1:] == h[:-1]
        twice[:-1] |= twice[1:]
        h, own = h[twice], own[twice]
        order = np.lexsort((own, h))
        h, own = h[order], own[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (own[1:] != own[:-1])]) if len(h) else np.zeros(0, bool)
        edge = np.flatnonzero(np.diff(h, prepend=h[:1] + np.uint64(1)))  # sets of each hash, counted once each
        count = np.repeat(np.add.reduceat(new.astype(np.int64), edge), np.diff(edge, append=len(h))) if len(h) else np.zeros(0, np.int64)
        good = count > 1
        token = ranks(count[good]) << np.uint64(56) | (np.uint64(number) << np.uint64(REST) | h[good]) & np.uint64((1 << 56) - 1)
        own = own[good]
        part = part_of(own, parts)
        order = np.lexsort((own, part))
        token, own, part = token[order], own[order], part[order]
        bounds, out = np.flatnonzero(np.diff(part, prepend=-1, append=parts)), []
        for a, b in zip(bounds, bounds[1:]):
            first = np.flatnonzero(np.diff(own[a:b], prepend=own[a] - 1))
            out.append((None, None, None, None, int(part[a]), flat(own[a:b][first]), flat(np.diff(first, append=b - a).astype(np.uint32)), flat(token[a:b])))
        return pd.DataFrame(out, columns=columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = -1, ([], [], [])
        for b in batches:
            texts = b["rest"].isna()
            if texts.any():
                own = b.loc[texts, ["id", "key", "n", "set_key"]]
                yield own.assign(part=part_of(own["key"].to_numpy(np.int64), parts), keys=None, many=None, tokens=None)
            for number, *blobs in b.loc[~texts, ["range", "rest", "keys", "many"]].itertuples(index=False):
                if number != now:
                    if held[0]:
                        yield tokens(now, *held)
                    now, held = number, ([], [], [])
                for x, y in zip(held, blobs, strict=True):
                    x.append(y)
        if held[0]:
            yield tokens(now, *held)

    return run


def _prefixed(percent: int):
    """Prefixes of the sets whose prefix has tokens of other sets: reads rows sorted by part, sets (key, node, n) and their tokens (keys, many, tokens)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, ([], [], [], [])
        for b in batches:
            for part, *row in b[["part", "key", "node", "n", "keys", "many", "tokens"]].itertuples(index=False):
                if part != now:
                    yield from prefixes(*held)
                    now, held = part, ([], [], [], [])
                if row[5] is None:
                    held[0].append(tuple(map(int, row[:3])))
                else:
                    for x, y in zip(held[1:], row[3:], strict=True):
                        x.append(y)
        yield from prefixes(*held)

    def prefixes(sets: list[tuple], keys: list[bytes], many: list[bytes], tokens: list[bytes]) -> Iterator[pd.DataFrame]:
        if not keys:
            return
        t = np.concatenate([unflat(x, np.uint64) for x in tokens])
        whose = np.repeat(np.concatenate([unflat(x, np.int64) for x in keys]), np.concatenate([unflat(x, np.uint32) for x in many]))
        order = np.argsort(whose, kind="stable")
        t, whose = t[order], whose[order]
        del order
        for i in range(0, len(sets), ROWS):
            some, out = sets[i : i + ROWS], []
            names = np.array([x[0] for x in some], np.int64)
            for (key, node, n), a, b in zip(some, np.searchsorted(whose, names).tolist(), np.searchsorted(whose, names, side="right").tolist(), strict=True):
                if a == b:
                    continue
                row = prefix(key, node, n, np.unique(t[a:b]))  # rows that repeat in other tasks bring theirs again
                if row:
                    out.append(row)
            yield pd.DataFrame(out, columns=_PREFIXED.replace(",", "").split()[::2])

    def prefix(key: int, node: int, n: int, t: np.ndarray) -> tuple | None:
        own = n - len(t)
        p = t[: max(0, prefix_length(n, percent) - own)]
        if not len(p):
            return None
        group = xxhash.xxh3_64_intdigest(p.tobytes() if own == 0 else p.tobytes() + int(key).to_bytes(8, "little", signed=True), seed=n)
        h = t * np.uint64(MIX[0])
        at = np.unique((h ^ (h >> np.uint64(31))) % np.uint64(64 * BITMAP))
        bits = np.zeros(64 * BITMAP, np.uint8)
        bits[at] = 1
        return key, node, n, own, np.uint64(group).view(np.int64), p.view(np.int64), *np.packbits(bits).view(np.int64).tolist()

    return run


_PREFIXED = "key long, node long, n long, own long, g long, prefix array<long>, " + ", ".join(f"b{i} long" for i in range(BITMAP))


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, id, t) of the rows with an id: ``key`` is the id, or a hash of id and text for ids that several rows have."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).filter("id is not null")
    many = staged(rows.groupBy("id").count().filter("count > 1").select("id"), "repeated-ids")
    if many.isEmpty():
        return rows.select(F.col("id").alias("key"), "id", "t")
    return rows.select(F.when(bit_filter(many, "id"), F.xxhash64("id", "t")).otherwise(F.col("id")).alias("key"), "id", "t")


def verified(rows: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (u, v) of keys whose texts have the similarity."""
    many = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    pairs = staged(pairs.join(many, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("chunks")).alias("chunk")), "pairs")
    ends = pairs.select(F.col("u").alias("key")).unionByName(pairs.select(F.col("v").alias("key")))
    rows = rows.select("key", "t").filter(bit_filter(ends, "key"))
    heads = rows.join(pairs.select("u", "chunk").distinct(), F.col("key") == F.col("u")).select("u", "chunk", F.lit(0).alias("tail"), F.col("u").alias("v"), "t")
    tails = rows.join(pairs, F.col("key") == F.col("v")).select("u", "chunk", F.lit(1).alias("tail"), "v", "t")

    links = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, now, own = Words(), None, None
        for b in batches:
            out = []
            for u, chunk, tail, v, t in rows_of(b):
                s = shingles(t, known, width)
                if not tail:
                    now, own = (u, chunk), s
                elif (u, chunk) == now and min(len(s), len(own)) * 100 >= percent * max(len(s), len(own)) > 0:
                    both = len(s) + len(own) - len(np.union1d(s, own))
                    if 100 * both >= percent * (len(s) + len(own) - both):
                        out.append((u, v))
            yield batch_of(out, links)

    together = heads.unionByName(tails).repartition("u", "chunk").sortWithinPartitions("u", "chunk", "tail")
    out = staged(together.mapInArrow(released(checked), "u long, v long").distinct(), "verified")
    unstage(pairs)
    return out


def banded() -> Column:
    """A class of a list's members: by size, shingles that other sets have too, and those before and from the shared place on, each
    within some nine percent. The number of classes of a list doesn't grow with its members."""
    return F.xxhash64(*[F.floor(F.log2(F.expr(x) + 1) * 8) for x in ("n", "n - own", "at - own", "n - at")])


def alike_classes(members: DataFrame, percent: int) -> DataFrame:
    """(l, k, k2): pairs of classes of a list whose members can be alike by their classes' extremes; ``k`` has a member to be paired."""
    bounds = members.groupBy("l", "k").agg(F.bool_or(F.col("c") != F.col("most")).alias("asks"), F.min("n").alias("n"), F.max("n").alias("m"), F.max(F.expr("n - own")).alias("s"), F.max(F.expr("at - own")).alias("f"), F.max(F.expr("n - at")).alias("t"))
    bounds = staged(bounds, "classes")
    other = bounds.select("l", *[F.col(c).alias(f"{c}2") for c in ("k", "n", "m", "s", "f", "t")])
    can = f"100 * least(m, m2) >= {percent} * greatest(n, n2) and {100 + percent} * least(s, s2) >= {percent} * (n + n2) and {100 + percent} * (least(f, f2) + least(t, t2)) >= {percent} * (n + n2)"
    return bounds.filter("asks").join(other, "l").filter(can).select("l", "k", "k2")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``docs``.

    Words are runs without ASCII white space after lower-casing A-Z; a set holds the distinct ``width``-word shingles, or the
    whole sequence where there are fewer words. Documents link when 100 * intersection >= ``percent`` * union; a component is
    named by its least id. A null text, or one without words, has an empty set and its own id. Rows that share an id are one
    document for linking. A null id takes no part and comes with a null component. An empty table gives no rows.
    """
    rows = keyed(docs, key, text)
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    bits = (max(RANGES, size // (BYTES * RANGE)) - 1).bit_length()
    ranged = rows.select("key", "id", "t").mapInArrow(released(_cut(width, bits)), _RANGED).repartition("range").sortWithinPartitions("range")
    parts = max(PARTS, (1 << bits) // DEALT)
    counted = staged(ranged.mapInPandas(released(_counted(bits, parts)), _COUNTED), "counted")
    base = counted.filter("tokens is null").select("id", "key", "n", "set_key", "part")
    sets = base.filter("n > 0").groupBy("set_key").agg(F.min("id").alias("node"))
    owners = staged(base.join(sets, "set_key", "left").select("id", "key", "n", "node", "part"), "owners")
    each = owners.filter("node is not null").select("part", "key", "node", "n").distinct()
    zero = F.lit(0).cast("long")  # no nulls: pandas would make them floats
    dealt = counted.filter("tokens is not null").select("part", zero.alias("key"), zero.alias("node"), zero.alias("n"), "keys", "many", "tokens").unionByName(each, allowMissingColumns=True)
    found = staged(dealt.repartition("part").sortWithinPartitions("part").mapInPandas(released(_prefixed(percent)), _PREFIXED), "prefixes")
    one = found.groupBy("node").agg(F.min("key").alias("key"))  # a set that several tasks met counts once
    members = staged(found.join(one, ["node", "key"]).select(*found.columns), "members")
    unstage(found)
    heads = members.groupBy("g").agg(F.min("key").alias("head"), F.first("n").alias("n"), F.first("own").alias("own"), F.count(F.lit(1)).alias("members"), F.min(F.struct("key", "prefix"))["prefix"].alias("prefix"))
    hits = heads.select("g", "members", "own", F.posexplode("prefix").alias("at", "h"))
    # tokens with equal lists of groups become one, of which the first place counts
    lists = hits.groupBy("h").agg(F.sum("members").alias("m"), *[F.bit_xor(F.xxhash64("g", F.lit(i))).alias(f"x{i}") for i in range(2)]).filter("m > 1")
    hits = hits.join(lists.select("h", F.xxhash64("x0", "x1").alias("l")), "h").groupBy("l", "g").agg(F.min(F.col("at") + F.col("own")).alias("at"))
    hits = staged(hits, "shared")
    heads = heads.drop("prefix")
    rank = hits.join(heads.select("g", (F.col("own") / F.col("n")).alias("alone")), "g")
    best = [F.min(F.struct("alone", F.xxhash64("g").alias("r"), "g"))["g"], *[F.min(F.struct(F.xxhash64("g", F.lit(i)).alias("r"), "g"))["g"] for i in range(1, CENTRES)]]
    centres = rank.groupBy("l").agg(F.array_distinct(F.array(*best)).alias("centres")).select("l", F.explode("centres").alias("centre"))
    # of n shingles, those after a shared one and those of its own bound what a set can share
    enough = f"{100 + percent} * least(n - own, n2 - own2) >= {percent} * (n + n2) and {100 + percent} * (least(at - own, at2 - own2) + least(n - at, n2 - at2)) >= {percent} * (n + n2)"
    stars = hits.join(heads.select("g", "head", "n", "own"), "g")
    centres = centres.join(hits.select("l", F.col("g").alias("centre"), F.col("at").alias("at2")), ["l", "centre"])
    centres = centres.join(heads.select(F.col("g").alias("centre"), F.col("head").alias("head2"), F.col("n").alias("n2"), F.col("own").alias("own2")), "centre")
    stars = stars.join(centres, "l").filter("g <> centre").filter(enough)
    inner = members.join(heads.filter("members > 1").select("g", "head"), "g").filter("key <> head")
    ordered = lambda df: df.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    first = ordered(stars.select(F.col("head").alias("a"), F.col("head2").alias("b")).unionByName(inner.select(F.col("head").alias("a"), F.col("key").alias("b"))))
    first = staged(first, "first")
    links = verified(rows, first, width, percent)
    joined = members.select("g", "key", "n", "own", *[f"b{i}" for i in range(BITMAP)]).join(connected(links).withColumnRenamed("node", "key"), "key", "left")
    joined = staged(joined.withColumn("c", F.coalesce("component", "key")).drop("component"), "joined")
    # what the first round has not joined: of a list, the members outside its largest component against all others
    parts = hits.join(joined.groupBy("g", "c").agg(F.count(F.lit(1)).alias("k")), "g").groupBy("l", "c").agg(F.sum("k").alias("k"))
    open_ = parts.groupBy("l").agg(F.max(F.struct("k", "c"))["c"].alias("most"), F.count(F.lit(1)).alias("components")).filter("components > 1").select("l", "most")
    left = staged(hits.join(open_, "l").join(joined, "g").withColumn("k", banded()), "open")
    alike = alike_classes(left, percent)
    other = left.select("l", *[F.col(c).alias(f"{c}2") for c in ("key", "n", "own", "at", "c", "k")], *[F.col(f"b{i}").alias(f"o{i}") for i in range(BITMAP)])
    # each bit that differs stands for a shingle of one set that the other lacks
    differ = " + ".join(f"bit_count(b{i} ^ o{i})" for i in range(BITMAP))
    apart = f"c <> c2 and (c2 = most or key < key2) and 100 * least(n, n2) >= {percent} * greatest(n, n2) and {enough} and {100 + percent} * ((n - own + n2 - own2 - ({differ})) div 2) >= {percent} * (n + n2)"
    met = left.filter("c <> most").join(alike, ["l", "k"]).join(other, ["l", "k2"]).filter(apart)
    second = staged(ordered(met.select(F.col("key").alias("a"), F.col("key2").alias("b"))).join(first, ["u", "v"], "left_anti"), "second")
    links = links.unionByName(verified(rows, second, width, percent))
    # links between the first nodes of sets, and between the sets of an id that several rows have
    node = owners.filter("node is not null").select("key", "node").distinct()
    links = links.join(node.select(F.col("key").alias("u"), F.col("node").alias("a")), "u").join(node.select(F.col("key").alias("v"), F.col("node").alias("b")), "v").select("a", "b")
    same = owners.filter("node is not null").groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("most")).filter("a <> most").select("id", "a")
    same = same.join(owners.filter("node is not null").select("id", F.col("node").alias("b")), "id").select("a", "b")
    component = connected(ordered(links.unionByName(same)))
    out = owners.join(component, "node", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "node", "id").alias("component_id"))
    out = staged(out, "components")
    for done in (counted, owners, members, hits, first, joined, left, second):
        unstage(done)
    nulls = docs.filter(F.col(key).isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(nulls)
