"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded order; a row's fractional rank is (rank - 1/2) / rows of its source. All rows sorted
by it are cut into shards of equal counts, so each shard has each source in the proportion of the whole table.

Ranks come from two levels: counts by hash bucket give offsets, and only rows of one bucket are numbered together. No source
and no shard is sorted in one task, and texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.llm.common import key_text, shielded, staged

#: Buckets of the fractional rank; each holds about rows / FRACTION_BUCKETS rows.
FRACTION_BUCKETS = 4096


def interleave(docs: DataFrame, shards: int, seed: int = 0, key: str = "doc_id", stratum: str = "source", ties: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (place within it, from 0); shard sizes differ by one row at most.

    A null stratum is a stratum of its own, a null key counts as empty. Rows with equal keys are ordered by ``ties``; rows equal
    in all of these are interchangeable. An empty table gives no rows. Columns of ``docs`` named shard or slot are replaced.
    """
    docs, back = shielded(docs.drop("shard", "slot"))
    rows = docs.withColumn("__s", F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")))
    rows = rows.withColumn("__h", F.md5(F.concat_ws("|", F.lit(str(seed)), key_text(key)))).withColumn("__b", F.substring("__h", 1, 3))
    counts = rows.groupBy("__s", "__b").agg(F.count(F.lit(1)).alias("__n"))
    source = Window.partitionBy("__s")
    offsets = counts.withColumn("__from", F.sum("__n").over(source.orderBy("__b")) - F.col("__n")).withColumn("__of", F.sum("__n").over(source)).drop("__n")
    inner = Window.partitionBy("__s", "__b").orderBy("__h", F.col(key), *ties)
    ranked = rows.join(offsets, ["__s", "__b"]).withColumn("__rank", F.col("__from") + F.row_number().over(inner))
    ranked = ranked.withColumn("__frac", (2 * F.col("__rank") - 1).cast("double") / (2 * F.col("__of")).cast("double"))
    ranked = staged(ranked.withColumn("__q", F.floor(F.col("__frac") * FRACTION_BUCKETS).cast("int")).drop("__b", "__from", "__of", "__rank"), "shard-ranks")
    per = ranked.groupBy("__q").agg(F.count(F.lit(1)).alias("__n"))
    every = Window.partitionBy(F.lit(0))  # one row for each of FRACTION_BUCKETS
    per = per.withColumn("__base", F.sum("__n").over(every.orderBy("__q")) - F.col("__n")).withColumn("__all", F.sum("__n").over(every)).drop("__n")
    place = Window.partitionBy("__q").orderBy("__frac", "__s", "__h", F.col(key), *ties)
    out = ranked.join(per, "__q").withColumn("__pos", F.col("__base") + F.row_number().over(place) - 1)
    out = out.withColumn("shard", F.expr(f"cast(__pos * {int(shards)} div __all as int)"))
    out = out.withColumn("slot", F.expr(f"__pos - (shard * __all + {int(shards) - 1}) div {int(shards)}").cast("long"))
    return out.select(*docs.columns, "shard", "slot").withColumnsRenamed(back)
