"""Chat formatting by perspective rotation.

For every participant of a dialogue the dialogue is rendered once with that participant as the assistant; all others are
users with their names, and the loss mask covers what the participant says (text and end mark). Participants are the distinct
roles but ``system``, whose messages stay system messages in every perspective.

A dialogue of more than ``part_messages`` messages comes in parts of so many, so that no group is unbounded, whatever its turns
are; offsets count from the start of the part, and ``part_base`` is the part's own offset in the whole rendering. Messages are
numbered without sorting a dialogue in one task: counts by block of turns, and by turn, role and hash within a block, give offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the template.
OPEN, CLOSE, END = "<|", "|>", "<|end|>\n"
#: Messages of a part; turn numbers of a block.
PART_MESSAGES, TURNS = 4096, 256


def rotate(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_messages: int = PART_MESSAGES) -> DataFrame:
    """conv_id, perspective, part, part_base, n_turns, n_own, rendered, mask (array of start, end in characters).

    Rows equal in dialogue, turn, role and text count once. Messages are ordered by turn, then role, then md5 of the text. A null role
    is the participant 'unknown', a null text is empty, a null turn comes first, a null dialogue id is a dialogue.
    A dialogue with system messages alone has no participant and gives no rows; an empty table gives none. Template marks
    within a text or role are broken by a space after '<'. Other columns are ignored.
    """
    plain = lambda c: F.regexp_replace(c, r"<\|", "< |")
    rows = conversations.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        plain(F.coalesce(F.col(role).cast("string"), F.lit("unknown"))).alias("role"),
        plain(F.coalesce(F.col(text), F.lit(""))).alias("text"),
    ).withColumn("m", F.md5(F.col("text").cast("binary")))
    rows = rows.dropDuplicates(["conv_id", "turn", "role", "m"])
    marks = rows.select("conv_id", F.floor(F.col("turn") / TURNS).alias("block"), "turn", "role", F.substring("m", 1, 2).alias("h"), "m")

    def offsets(within: list[str], by: list[str], name: str) -> DataFrame:
        counts = marks.groupBy(*within, *by).agg(F.count(F.lit(1)).alias("__n"))
        before = Window.partitionBy(*within).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        return counts.select(*[F.col(c).alias(f"__{c}") for c in [*within, *by]], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(name))

    place = ["conv_id", "block", "turn", "role", "h"]
    numbers = marks.withColumn("at", F.row_number().over(Window.partitionBy(*place).orderBy("m")) - 1)
    for within, by, name in ((place[:1], place[1:2], "base"), (place[:2], place[2:], "inner")):
        on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*within, *by]]
        numbers = numbers.join(offsets(within, by, name), on).drop(*[f"__{c}" for c in [*within, *by]])
    numbers = numbers.select(*[F.col(c).alias(f"__{c}") for c in ("conv_id", "turn", "role", "m")], (F.col("base") + F.col("inner") + F.col("at")).alias("pos"))
    rows = rows.join(numbers, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("conv_id", "turn", "role", "m")]).withColumn("part", F.expr(f"pos div {int(part_messages)}"))
    parts = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("messages"))
    people = rows.filter(F.col("role") != "system").select(F.col("conv_id").alias("__c"), F.col("role").alias("perspective")).distinct()
    each = parts.join(people, F.col("conv_id").eqNullSafe(F.col("__c"))).drop("__c")
    head = lambda m: F.when(m["role"] == "system", F.lit(f"{OPEN}system{CLOSE}")).when(m["role"] == F.col("perspective"), F.lit(f"{OPEN}assistant{CLOSE}")).otherwise(F.concat(F.lit(f"{OPEN}user name="), m["role"], F.lit(CLOSE)))
    pieces = F.transform("messages", lambda m: F.struct(head(m).alias("head"), F.concat(m["text"], F.lit(END)).alias("body"), (m["role"] == F.col("perspective")).alias("own")))
    each = each.withColumn("pieces", pieces)
    width = lambda p: F.length(p["head"]) + F.length(p["body"])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    step = lambda a, p: F.struct(
        (a["at"] + width(p)).alias("at"),
        F.when(p["own"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(p["head"])).alias("start"), (a["at"] + width(p)).alias("end"))))).otherwise(a["spans"]).alias("spans"),
    )
    each = each.withColumn("walk", F.aggregate("pieces", start, step))
    before = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return each.select(
        "conv_id",
        "perspective",
        "part",
        F.coalesce(F.sum(F.col("walk.at").cast("long")).over(before), F.lit(0)).cast("long").alias("part_base"),
        F.size("messages").alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p["own"])).alias("n_own"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("rendered"),
        F.col("walk.spans").alias("mask"),
    )
