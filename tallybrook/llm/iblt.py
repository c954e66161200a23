"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraph cells.

A text's paragraphs are cut into cells of some 24 bytes (21 to 64): a cell ends where a hash of the last three bytes, whatever characters they are
part of, has one of four values, so cuts come back after an insertion. A cell's 64-bit digest tells its k-th occurrence
in the text from the others. A digest goes into one place of each of three sub-tables (count, xor of digests, xor of check hashes);
its place is the value of 21 bits of its own. Subtracting two sketches cancels what the texts share; peeling places with one digest left
recovers the digests in which they differ, and so the exact likeness of the two collections of cells (sum of the lesser counts over sum of the
greater). Sub-tables are powers of two, so a sketch folds to smaller sizes: peeling starts on a quarter of the places where few are
taken, and is tried again on all of them. Only where that fails too (about 0.6 cells of difference for each cell of the text and more,
as between unrelated texts) the two collections of digests are subtracted themselves.

Only DataFrame and SQL functions are used. Texts are shuffled once, into key-ordered buckets; sketches are built, subtracted and peeled within rows in
time n log n: places are runs of the sorted digests among markers, one for each place.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.llm.common import staged


def _cell() -> str:
    """A pattern over bytes as Latin-1 characters: at least 21 of a paragraph up to three whose classes sum to 0 modulo 4, at most 63."""
    classes = [["".join(f"\\x{b:02x}" for b in range(256) if b != 10 and zlib.crc32(bytes([b, salt])) % 4 == k) for k in range(4)] for salt in range(3)]
    ends = "|".join(f"[{classes[0][a]}](?:" + "|".join(f"[{classes[1][b]}][{classes[2][-(a + b) % 4]}]" for b in range(4)) + ")" for a in range(4))
    return rf"[^\n]{{18,60}}?(?:{ends})|[^\n]{{1,63}}"


CELL = _cell()
#: Bits of a digest that tell its place in a sub-table, and so the largest power of two of a sub-table.
PLACE_BITS = 21
#: Rows a bucket of neighbouring keys aims at; intervals of equal depth that buckets divide.
BUCKET_ROWS, KNOTS = 1024, 32
#: Rounds of peeling; share of empty places below which peeling is not tried, since it fails.
ROUNDS, EMPTY = 24, 0.08


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def digests(text: Column) -> Column:
    """A digest for each cell of a text; equal cells are numbered. The lowest bit is always set."""
    cells = F.regexp_extract_all(F.decode(text.cast("binary"), "ISO-8859-1"), F.lit(CELL), F.lit(0))
    return let(F.sort_array(F.transform(cells, lambda c: F.xxhash64(c).bitwiseOR(F.lit(1)))), lambda s: F.when(F.size(F.array_distinct(s)) == F.size(s), s).otherwise(numbered(s)))


def numbered(s: Column) -> Column:
    """Sorted digests, the k-th of equal ones mixed with k."""
    starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    run = lambda p, a, r: F.transform(F.sequence(F.lit(1), F.coalesce(F.get(p, r + 1), F.size(s)) - a), lambda k: F.when(k == 1, F.get(s, a)).otherwise(F.xxhash64(F.get(s, a), k).bitwiseOR(F.lit(1))))
    return let(starts, lambda p: F.flatten(F.transform(p, lambda a, r: run(p, a, r))))


def power(n: Column) -> Column:
    """log2 of a sub-table's places, so that three have about 0.75 to 1.5 places for each digest."""
    return F.least(F.lit(PLACE_BITS), F.greatest(F.lit(3), F.ceil(F.log2(F.greatest(n, F.lit(1)) / 4.0)))).cast("int")


def turned(x: Column, i: int) -> Column:
    """``x`` with the bits first that tell its place in sub-table i."""
    return x if not i else F.shiftleft(x, PLACE_BITS * i).bitwiseOR(F.shiftrightunsigned(x, 64 - PLACE_BITS * i))


def turned_back(x: Column, i: int) -> Column:
    return x if not i else F.shiftrightunsigned(x, PLACE_BITS * i).bitwiseOR(F.shiftleft(x, 64 - PLACE_BITS * i))


def shift(x: Column, by: Column, how: str) -> Column:
    return F.call_function(how, x, by)


def check(x: Column) -> Column:
    return F.xxhash64(x, F.lit(99))


def sketch(d: Column, q: Column) -> Column:
    """Places (n, k, c) of the three sub-tables of 2^q for digests ``d``; a digest whose lowest bit isn't set counts as minus one."""
    half = shift(F.lit(1).cast("long"), q - 1, "shiftleft")
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c"))

    def sub_table(i: int) -> Column:
        own = lambda x: turned_back(x, i).bitwiseOR(F.lit(1))
        markers = F.transform(F.sequence(-half, half - 1), lambda j: shift(j, F.lit(64) - q, "shiftleft"))
        sign = lambda x: turned_back(x, i).bitwiseAND(F.lit(1)) * 2 - 1

        def place(run: Column) -> Column:
            none = F.lit(0).cast("long")
            return F.struct(F.aggregate(run, none, lambda a, x: a + sign(x)).alias("n"), F.aggregate(run, none, lambda a, x: a.bitwiseXOR(own(x))).alias("k"), F.aggregate(run, none, lambda a, x: a.bitwiseXOR(check(own(x)))).alias("c"))

        def runs(s: Column, p: Column) -> Column:
            length = lambda a, r: F.coalesce(F.get(p, r + 1), F.size(s)) - a - 1
            one = lambda x: F.struct(sign(x).alias("n"), own(x).alias("k"), check(own(x)).alias("c"))
            return F.transform(p, lambda a, r: let(length(a, r), lambda n: F.when(n == 0, zero).when(n == 1, one(F.get(s, a + 1))).otherwise(let(F.slice(s, a + 2, n), place))))

        both = F.sort_array(F.concat(F.transform(d, lambda x: turned(x, i)), markers))
        starts = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda at: shift(F.get(s, at), q, "shiftleft") == 0)
        return let(both, lambda s: let(starts(s), lambda p: runs(s, p)))

    return F.concat(*[sub_table(i) for i in range(3)])


def fold(cells: Column, q: Column, to: Column) -> Column:
    """A sketch with sub-tables of 2^q places as one of 2^to: neighbouring places are put together."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c"))
    add = lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), a["k"].bitwiseXOR(x["k"]).alias("k"), a["c"].bitwiseXOR(x["c"]).alias("c"))
    width = shift(F.lit(1), q - to, "shiftleft")
    small = F.transform(F.sequence(F.lit(0), shift(F.lit(1), to, "shiftleft") * 3 - 1), lambda j: F.aggregate(F.slice(cells, j * width + 1, width), zero, add))
    return F.when(q == to, cells).otherwise(small)


def less(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["c"].bitwiseXOR(y["c"]).alias("c")))


def alone(cells: Column) -> Column:
    """The distinct digests that places hold alone; those of the second sketch have their lowest bit unset."""
    one = F.filter(cells, lambda x: (F.abs(x["n"]) == 1) & (x["c"] == check(x["k"])))
    return F.array_distinct(F.transform(one, lambda x: F.when(x["n"] == 1, x["k"]).otherwise(x["k"].bitwiseAND(F.lit(-2)))))


def peel(cells: Column, q: Column) -> Column:
    """(found, done) after ROUNDS rounds; each takes the digests that stand alone out of all their places."""
    state = lambda left, now, found: F.struct(left.alias("left"), now.alias("now"), found.alias("found"))
    step = lambda st: let(less(st["left"], sketch(st["now"], q)), lambda left: state(left, alone(left), F.concat(st["found"], st["now"])))
    end = lambda st: F.struct(st["found"].alias("found"), F.coalesce(F.forall(st["left"], lambda x: (x["n"] == 0) & (x["k"] == 0) & (x["c"] == 0)), F.lit(False)).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state(cells, alone(cells), F.array().cast("array<bigint>")), lambda st, _: F.when(F.size(st["now"]) == 0, st).otherwise(step(st)), end)


def difference(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds ``out``: the digests that only one of the sketches ``a`` and ``b`` (structs of q, n, cells) has, those of ``b`` with
    the lowest bit unset; null where peeling fails."""
    df = df.withColumn("__q", F.least(F.col(f"{a}.q"), F.col(f"{b}.q")))
    df = df.withColumn("__d", less(fold(F.col(f"{a}.cells"), F.col(f"{a}.q"), F.col("__q")), fold(F.col(f"{b}.cells"), F.col(f"{b}.q"), F.col("__q"))))
    df = df.withColumn("__empty", F.size(F.filter("__d", lambda x: (x["n"] == 0) & (x["k"] == 0) & (x["c"] == 0))) / F.size("__d"))
    df = df.withColumn("__small", F.greatest(F.lit(3), F.col("__q") - 2))
    failed = F.lit(None).cast("struct<found:array<bigint>,done:boolean>")
    # a quarter of the places can hold a difference that leaves 0.7 of all places empty
    few = (F.col("__empty") > 0.7) & (F.col("__small") < F.col("__q"))
    df = df.withColumn("__first", F.when(few, let(fold(F.col("__d"), F.col("__q"), F.col("__small")), lambda f: peel(f, F.col("__small")))).otherwise(failed))
    df = df.withColumn("__peeled", F.when(F.col("__first.done"), F.col("__first")).when(F.col("__empty") >= EMPTY, peel(F.col("__d"), F.col("__q"))).otherwise(failed))
    return df.withColumn(out, F.when(F.col("__peeled.done"), F.col("__peeled.found"))).drop("__q", "__d", "__empty", "__small", "__first", "__peeled")


def likeness(found: Column, d1: Column, d2: Column) -> Column:
    """From the digests that differ where peeling found them, else by subtracting the collections; 1 for two texts without cells."""
    both = F.size(d1) + F.size(d2)
    shared = F.when(found.isNotNull(), (both - F.size(found)) / 2).otherwise(F.size(F.array_intersect(d1, d2)).cast("double"))
    return F.when(both == 0, F.lit(1.0)).otherwise(let(shared, lambda x: x / (both - x)))


def bucket(docs: DataFrame, key: str) -> Column:
    """A number that never falls as the key rises: equal-depth intervals, cut into cells of equal width. Nulls come first."""
    rows, knots = docs.agg(F.count(F.lit(1)), F.percentile_approx(key, [i / KNOTS for i in range(KNOTS + 1)])).first()
    if not knots:
        return F.lit(-1).cast("long")
    cells = max(1, rows // (KNOTS * BUCKET_ROWS)) if rows > KNOTS * BUCKET_ROWS // 4 else 1
    table = F.array(*[F.lit(int(k)) for k in knots])
    i = F.least(F.size(F.filter(F.slice(table, 2, KNOTS), lambda k: k <= F.col(key))), F.lit(KNOTS - 1))
    low, high = F.element_at(table, i + 1), F.element_at(table, i + 2)
    inner = F.floor((F.col(key) - low) / F.greatest(high - low, F.lit(1)) * cells)
    return F.when(F.col(key).isNull(), F.lit(-1)).otherwise(i * cells + F.greatest(F.lit(0), F.least(inner, F.lit(cells - 1)))).cast("long")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", sketches: bool = False) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, one row per row of ``docs``.

    Fingerprints are short names of sketches: they tell equal from different only, likeness comes from the sketches. With ``sketches``
    there follow the sketches themselves (q, n, cells) as ``own`` and ``edited``, and the digests that only the text (``only_own``) or
    only its edited text (``only_edited``) has.

    The edited text has its last quarter of code points replaced by as many from the start of the next document by ascending key
    (rows with equal keys by text, null keys first; after the last comes the first; a lone document follows itself). A null text is
    empty. Texts without cells are alike (1.0), and have nothing in common with others; line ends belong to no cell. A short text has few
    cells, so its likeness is coarse. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("bucket", bucket(rows, "doc_id"))
    first = rows.groupBy("bucket").agg(F.min("doc_id").alias("f")).withColumnRenamed("bucket", "b")
    first = rows.join(staged(first, "first-keys"), (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("f"))).groupBy("bucket").agg(F.min("text").alias("head"))
    line = Window.partitionBy(F.lit(0)).orderBy("bucket")  # one row per bucket
    first = staged(first, "first-texts")
    after = first.select("bucket").withColumn("b", F.coalesce(F.lead("bucket").over(line), F.first("bucket").over(line)))
    heads = staged(after.join(first.withColumnRenamed("bucket", "b"), "b").select("bucket", "head"), "next-texts")
    # each bucket ends with the first text of the next one
    rows = rows.withColumn("guest", F.lit(0)).unionByName(heads.select(F.lit(None).cast(rows.schema["doc_id"].dataType).alias("doc_id"), F.col("head").alias("text"), "bucket", F.lit(1).alias("guest")))
    order = Window.partitionBy("bucket").orderBy("guest", "doc_id", "text")
    rows = rows.repartition("bucket").withColumn("next", F.lead("text").over(order))
    sketched = lambda df, d, name: df.withColumn("q", power(F.size(d))).withColumn(name, F.struct("q", F.size(d).alias("n"), sketch(F.col(d), F.col("q")).alias("cells"))).drop("q")
    rows = sketched(rows.withColumn("d0", digests(F.col("text"))), "d0", "own")
    rows = rows.withColumns({"d2": F.lead("d0").over(order), "following": F.lead("own").over(order)}).filter("guest = 0")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("changed", F.expr("concat(left(text, cast(n_chars - n_chars div 4 as int)), left(next, cast(n_chars div 4 as int)))"))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("changed").cast("binary"), 256).alias("edited_sha256"), "d0", "own", digests(F.col("changed")).alias("d1"), "d2", "following")
    rows = sketched(rows, "d1", "edited")
    rows = difference(difference(rows, "own", "edited", "e1"), "own", "following", "e2")
    found = [digest("own").alias("fingerprint"), digest("edited").alias("edited_fingerprint"), likeness(F.col("e1"), F.col("d0"), F.col("d1")).alias("near_edited"), likeness(F.col("e2"), F.col("d0"), F.col("d2")).alias("near_next")]
    if sketches:
        plus, minus = F.filter("e1", lambda x: x.bitwiseAND(F.lit(1)) == 1), F.transform(F.filter("e1", lambda x: x.bitwiseAND(F.lit(1)) == 0), lambda x: x.bitwiseOR(F.lit(1)))
        found += ["own", "edited", F.coalesce(plus, F.array_except("d0", "d1")).alias("only_own"), F.coalesce(minus, F.array_except("d1", "d0")).alias("only_edited")]
    return rows.select("doc_id", "n_chars", "edited_sha256", *found)


def digest(sketch: str) -> Column:
    """A short name of a sketch: size, pieces, and 128 bits of hash of its cells."""
    s = F.col(sketch)
    return F.concat_ws("-", F.lit("ibl"), s["q"].cast("string"), s["n"].cast("string"), F.lower(F.lpad(F.hex(F.xxhash64(s["cells"])), 16, "0")), F.lower(F.lpad(F.hex(F.xxhash64(s["cells"], F.lit(7))), 16, "0")))
