"""Audit of how filters interact, with exact duplicates found by partition refinement.

Rows are split by their texts' lengths in code points, then by the hashes of successive blocks of code points; after each split rows
that stand alone are dropped. What is left is compared as whole text: equal texts of a class collapse within tasks before they are
shuffled, and rows that don't have the least id of their text are marked. Then rows are counted by the set of filters they fail; all
orders of the filters are evaluated on these counts.

A key with more than one in HOT of all rows is joined by broadcast, and there are fewer than HOT of them; other keys are shuffled.
Only lengths, hashes and marks are staged and shuffled, besides the texts that are left after refinement.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.llm.common import WORD, bit_filter, staged, unstage

#: Ends of the blocks of code points; the last block is the rest of the text.
BLOCKS = (64, 512, 4096)
#: A key with more than a HOT-th of the rows is hot.
HOT = 1000
FILTERS = "ABCDE"


def block_hashes(text: str) -> list[Column]:
    """The length in code points, then a hash of each block."""
    starts = (0, *BLOCKS)
    return [F.char_length(text).cast("long"), *[F.xxhash64(F.substring(text, a + 1, b - a)) for a, b in zip(starts, (*BLOCKS, 1 << 30), strict=True)]]


def by_key(rows: DataFrame, side: DataFrame, total: int, how: str) -> DataFrame:
    """``rows`` joined with ``side`` (k, n, ...: one row a key, n rows have it): hot keys by broadcast, the others by shuffle. ``how`` is inner or left_semi."""
    hot = F.broadcast(side.filter(F.col("n") * HOT > total))  # fewer than HOT keys
    rest = side.filter(F.col("n") * HOT <= total)
    return rows.join(hot, "k", how).unionByName(rows.join(hot.select("k"), "k", "left_anti").join(rest, "k", how))


def refined(rows: DataFrame, hashes: list[str], bits: int = 64) -> DataFrame:
    """Rows that share all of ``hashes`` with another row, after splitting by one more of them at a time; ``k`` is a hash of them all."""
    for i in range(len(hashes)):
        keyed = rows.withColumn("k", narrowed(F.xxhash64(*hashes[: i + 1]), bits))
        counts = staged(keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "counts")
        total = counts.agg(F.sum("n")).first()[0] or 0
        left = staged(by_key(keyed, counts.filter("n > 1"), total, "left_semi"), "refined")
        unstage(counts)
        if i:
            unstage(rows)
        rows = left.drop("k") if i + 1 < len(hashes) else left
    return rows


def narrowed(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits)


def duplicates(docs: DataFrame, rows: DataFrame, text: Column, key: str = "doc_id", bits: int = 64) -> DataFrame:
    """Those of ``rows`` whose text another row has under a smaller id.

    ``rows`` are staged rows made of ``docs`` by ``with_hashes``; ``text`` is the text in terms of ``docs``. Rows without id are not marked,
    and are no one's original. Rows that repeat the least id of a text aren't marked either. Hashes of ``bits`` bits only narrow down:
    where texts share all hashes but differ, they are told apart as whole texts.
    """
    hashes = [f"h{i}" for i in range(len(BLOCKS) + 2)]
    left = refined(rows, hashes, bits)
    whole = docs.select(F.col(key).alias("id"), text.alias("text")).withColumns(dict(zip(hashes, block_hashes("text"), strict=True)))
    whole = whole.withColumn("k", narrowed(F.xxhash64(*hashes), bits)).filter(bit_filter(left, "k"))
    texts = whole.groupBy("k", "text").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    least = staged(texts.groupBy("k").agg(F.count(F.lit(1)).alias("texts"), F.min("least").alias("least"), F.sum("n").alias("n")), "least-ids")
    total = least.agg(F.sum("n")).first()[0] or 0
    out = by_key(left, least.filter("texts = 1").select("k", "n", "least"), total, "inner").filter("id > least").select(*left.columns)
    clash = least.filter("texts > 1")
    if not clash.isEmpty():  # different texts with equal length and hashes
        same = texts.drop("n").join(clash.select("k"), "k", "left_semi")
        told = whole.join(clash.select("k"), "k", "left_semi").join(same, ["k", "text"]).filter("id > least").select("k", "id").distinct()
        out = out.unionByName(left.join(told, ["k", "id"], "left_semi").select(*left.columns))
    return out


def with_hashes(docs: DataFrame, text: Column, key: str, **more: Column) -> DataFrame:
    """``id``, the columns ``more`` and the hashes that refinement splits by; ``more`` may use ``__text``."""
    return docs.withColumn("__text", text).select(F.col(key).alias("id"), *[c.alias(n) for n, c in more.items()], *[h.alias(f"h{i}") for i, h in enumerate(block_hashes("__text"))])


def failures(text: str) -> Column:
    """The letters of the filters A to D that a text fails."""
    words = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    counts = F.transform(F.array(F.struct(words.alias("w"))), lambda s: F.struct(F.size(s["w"]).cast("long").alias("n"), F.size(F.array_distinct(s["w"])).cast("long").alias("d")))[0]
    told = F.transform(F.array(counts), lambda c: F.concat(F.when(c["n"] < 100, "A").otherwise(""), F.when(c["d"] * 100 < c["n"] * 80, "B").otherwise("")))[0]
    return F.concat(told, F.when(capitals.cast("long") * 100 > F.char_length(text).cast("long") * 10, "C").otherwise(""), F.when(F.col(text).rlike("[#$%&*|]"), "D").otherwise(""))


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang", bits: int = 64) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows for each value of ``part``.

    A row fails E if another row has its text under a smaller id; the other filters are ``failures``. Null texts are empty, null parts the
    empty string; a row without id fails no E and has no label; repeated rows count each. Of several labels of an id the highest
    counts, null ones don't. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    own = docs.select(F.col(key), F.col(text), F.col(part)).toDF("id_", "text_", "part_")
    whole = F.coalesce(F.col("text_"), F.lit(""))
    rows = with_hashes(own, whole, "id_", part=F.coalesce(F.col("part_"), F.lit("")), fails=failures("__text"))
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(F.coalesce(F.max("quality") == 1, F.lit(False)).alias("good"), F.coalesce(F.max("toxic") == 1, F.lit(False)).alias("toxic"))
    rows = rows.join(marks.filter("id is not null"), "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    rows = staged(rows, "audited")
    group = ["part", "fails", "good", "toxic"]
    every = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    twice = staged(duplicates(own, rows, whole, "id_", bits).groupBy(*group).agg(F.count(F.lit(1)).alias("n")), "duplicates")
    unmarked = twice.withColumn("n", -F.col("n"))
    masks = every.unionByName(unmarked).unionByName(twice.withColumn("fails", F.concat("fails", F.lit("E")))).groupBy(*group).agg(F.sum("n").alias("n")).filter("n > 0")
    return orders(masks)


def orders(masks: DataFrame) -> DataFrame:
    """All orders of the filters on counts ``n`` of rows by (part, fails, good, toxic)."""
    every = [*map("".join, permutations(FILTERS))]
    rows = masks.withColumn("filter_order", F.explode(F.split(F.lit(" ".join(every)), " "))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    without = lambda letters: f"translate(fails, {letters}, '') = fails"
    fails, before, after = "contains(fails, substring(filter_order, step, 1))", without("left(filter_order, step - 1)"), without("left(filter_order, step)")
    count = lambda condition, n="n": F.coalesce(F.sum(F.expr(f"case when {condition} then {n} end")), F.lit(0)).cast("long")
    return rows.groupBy("part", "filter_order", "step").agg(
        count(after).alias("kept"),
        count(f"{fails} and {before}").alias("removed"),
        count(f"{fails} and not {before}").alias("redundant"),
        count("fails = substring(filter_order, step, 1)").alias("unique_fails"),
        count(f"{fails} and {before} and good").alias("good_lost"),
        count(f"{fails} and {before} and toxic").alias("toxic_lost"),
        # a row that fails k filters is removed by each of them in one k-th of the orders
        count(fails, f"n * ({len(every)} div length(fails))").alias("shapley"),
    )
