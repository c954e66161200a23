"""Mixing sources to target weights: hierarchical token budgets over a domain / language / source tree.

A budget enters at the root. At each level a node's budget is split among its children in proportion to their weights; a
child that can't use its share (its capacity is its tokens times ``max_epochs``) is filled, and what it leaves goes to its
siblings. Since a node's capacity is the sum of its children's, a shortage reaches the node's own siblings only when all
children are full. Each leaf then takes whole seeded epochs and a token prefix of one more.

Only DataFrame functions are used. Ranks within a leaf come from two levels (hash bucket, then rows of the one bucket where
the cut falls), so no leaf, however hot, is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.llm.common import WORD, key_text, shielded, staged

BIG = "decimal(38,0)"


def token_count(text: Column) -> Column:
    """Words of a text; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def share(nodes: DataFrame, parent: Sequence[str], node: str, budget: str, out: str) -> DataFrame:
    """Splits ``budget`` of each parent among its children (``__cap``, ``__w``) by weight, filling children in order of cap/weight.

    All arithmetic is on whole tokens; a floor leaves at most one token per child unassigned.
    """
    among = Window.partitionBy(*parent)
    order = among.orderBy("__ratio", node)
    cap, w = F.col("__cap").cast(BIG), F.col("__w").cast(BIG)
    before = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast(BIG))
    rest_w = F.sum(w).over(order.rowsBetween(0, Window.unboundedFollowing))
    return (
        nodes.withColumn("__ratio", F.col("__cap").cast("double") / F.col("__w"))
        .withColumn("__before", before)
        .withColumn("__rest_w", rest_w)
        .withColumn("__full", (cap * F.col("__rest_w")).cast(BIG) <= ((F.col(budget).cast(BIG) - F.col("__before")) * w).cast(BIG))
        .withColumn("__left", F.col(budget).cast(BIG) - F.coalesce(F.sum(F.when(F.col("__full"), cap)).over(among), F.lit(0).cast(BIG)))
        .withColumn("__open_w", F.sum(F.when(~F.col("__full"), w)).over(among))
        .withColumn(out, F.when(F.col("__full"), F.col("__cap")).otherwise(F.expr("cast(__left as decimal(38,0)) * cast(__w as decimal(10,0)) div cast(__open_w as decimal(28,0))")).cast("long"))
        .drop("__ratio", "__before", "__rest_w", "__full", "__left", "__open_w")
    )


def budgets(leaves: DataFrame, path: Sequence[str], weights: Mapping[str, int], budget: int, max_epochs: int) -> DataFrame:
    """Leaf rows (``path``, ``__tokens``) with ``__budget``. ``weights``: by '/'-joined path, whole numbers of 1 or more; others weigh 1."""
    table = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, int(v))]) if weights else F.expr("map('', 1)")
    out = leaves.withColumn("__leafcap", F.col("__tokens") * F.lit(max_epochs)).withColumn("__b0", F.lit(budget).cast("long"))
    for depth in range(len(path)):
        level, above = list(path[: depth + 1]), list(path[:depth])
        caps = out.groupBy(*level).agg(F.sum("__leafcap").alias("__cap"), F.first(f"__b{depth}").alias(f"__b{depth}"))
        name = F.concat_ws("/", *level)
        caps = caps.withColumn("__w", F.coalesce(F.try_element_at(table, name), F.lit(1)))
        got = share(caps.withColumn("__one", F.lit(1)), above or ["__one"], level[-1], f"__b{depth}", f"__b{depth + 1}")
        out = staged(out.join(got.select(*level, f"__b{depth + 1}"), level), "mix-level")  # else each level's plan holds the one above twice
    return out.withColumnRenamed(f"__b{len(path)}", "__budget")


def mix(docs: DataFrame, path: Sequence[str], weights: Mapping[str, int], budget: int | None = None, budget_share: float = 1.0, max_epochs: int = 3, seed: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs``, one for each epoch that takes them, with ``mix_tokens``, ``mix_epoch``, ``mix_take``, ``mix_budget``.

    ``budget`` tokens, or ``budget_share`` of all tokens. Level columns that are null count as '(none)'. A null or empty text
    has no tokens; it comes with every whole epoch, and with the prefix if it lies before the cut. ``mix_take`` is how many
    tokens of the row the budget covers: all but for the last row of a prefix. A leaf's order within an epoch is by md5 of
    seed, epoch and key, then key and tokens; equal rows are interchangeable. An empty table gives no rows. Other columns
    are passed on; columns of ``docs`` named ``mix_*`` are replaced.
    """
    docs, names_back = shielded(docs.drop("mix_tokens", "mix_epoch", "mix_take", "mix_budget"))
    level = {c: f"__l{i}" for i, c in enumerate(path)}
    rows = docs.withColumns({v: F.coalesce(F.col(k).cast("string"), F.lit("(none)")) for k, v in level.items()}).withColumn("mix_tokens", token_count(F.col(text)))
    names = list(level.values())
    leaves = staged(rows.groupBy(*names).agg(F.sum("mix_tokens").alias("__tokens")), "mix-leaves")
    if budget is None:
        budget = int((leaves.agg(F.sum("__tokens")).first()[0] or 0) * budget_share)
    plan = budgets(leaves, names, weights, budget, max_epochs)
    safe = F.greatest(F.col("__tokens"), F.lit(1))
    plan = staged(plan.select(*names, "__tokens", "__budget", F.floor(F.col("__budget") / safe).cast("long").alias("__whole"), (F.col("__budget") % safe).alias("__rem")), "mix-plan")

    def hashed(df: DataFrame) -> DataFrame:
        h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("__whole").cast("string"), key_text(key)))
        return df.withColumn("__h", h).withColumn("__bucket", F.substring("__h", 1, 3))

    joined = hashed(rows.join(plan, names))
    upto = Window.partitionBy(*names).orderBy("__bucket")
    sums = joined.groupBy(*names, "__bucket").agg(F.sum("mix_tokens").alias("__n"), F.first("__rem").alias("__rem"))
    sums = sums.withColumn("__start", F.sum("__n").over(upto) - F.col("__n"))
    cut = sums.filter((F.col("__start") < F.col("__rem")) & (F.col("__start") + F.col("__n") >= F.col("__rem")))
    cut = staged(cut.select(*names, F.col("__bucket").alias("__cut"), "__start"), "mix-cuts")
    joined = hashed(rows.join(plan.join(cut, names, "left"), names))
    done = F.col("__bucket") < F.col("__cut")
    whole = joined.filter((F.col("__whole") > 0) | done)
    last = F.when(done, F.col("__whole")).otherwise(F.col("__whole") - 1)
    whole = whole.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("mix_take", F.col("mix_tokens"))
    order = Window.partitionBy(*names).orderBy("__h", F.col(key), "mix_tokens").rowsBetween(Window.unboundedPreceding, -1)
    edge = joined.filter(F.col("__bucket") == F.col("__cut")).withColumn("__at", F.col("__start") + F.coalesce(F.sum("mix_tokens").over(order), F.lit(0)))
    edge = edge.filter(F.col("__at") < F.col("__rem")).withColumn("mix_epoch", F.col("__whole")).withColumn("mix_take", F.least(F.col("mix_tokens"), F.col("__rem") - F.col("__at")))
    keep = [*docs.columns, "mix_tokens", "mix_epoch", "mix_take", F.col("__budget").alias("mix_budget")]
    return whole.select(*keep).unionByName(edge.select(*keep)).withColumnsRenamed(names_back)
