"""Templates of log bodies: mining by a fixed-depth prefix tree, and runs of bodies that fit a growing template.

The tree's levels are key columns: token count, then leading tokens; a token with a digit is a wildcard, and so are leading tokens beyond
the first CHILDREN - 1 of a node. A leaf's distinct bodies stream through one task in the order in which they first occur; the task
holds templates, not rows.

Runs depend on all rows before them. Ranges of a stream are worked on side by side, each from the state that the range before it is thought
to leave behind (a bucket and a template), and again where that state turns out different, until nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.operators import ranges

#: The wildcard, children of a node (the wildcard's included), least depth and levels above the leading tokens.
WILDCARD, CHILDREN, LEAST_DEPTH, UPPER_LEVELS = "<*>", 100, 3, 3


class Leaf:
    """Templates of a leaf, in the order they were founded. Only tokens of templates are remembered."""

    def __init__(self, length: int) -> None:
        self.names: dict[str, int] = {WILDCARD: 0}
        self.tokens: list[list[str]] = []
        self.first: list[int] = []
        self.ids = np.zeros((8, length), np.int32)
        self.wild = np.zeros(8, np.int64)

    def add(self, tokens: list[str], pos: int, threshold: float) -> int:
        """The template that a body joins: of the most equal tokens, then, where these are too few, of the most with wildcards equal."""
        k, n = len(self.tokens), len(tokens)
        if k:
            x = np.array([self.names.get(t, -1) for t in tokens], np.int32)
            same = ((self.ids[:k] == x) & (self.ids[:k] != 0)).sum(1)
            for score in (same, same + self.wild[:k]):
                best = np.flatnonzero(score == score.max())
                if n == 0 or score[best[0]] / n >= threshold:
                    i = int(best[np.argmax(self.wild[best])])  # the one with more wildcards, then the older
                    differ = self.ids[i] != x
                    self.ids[i][differ] = 0
                    self.wild[i] = (self.ids[i] == 0).sum()
                    self.tokens[i] = [WILDCARD if d else t for t, d in zip(self.tokens[i], differ, strict=True)]
                    return i
        if k == len(self.ids):
            self.ids, self.wild = np.concatenate([self.ids, np.zeros_like(self.ids)]), np.concatenate([self.wild, np.zeros_like(self.wild)])
        self.ids[k] = [self.names.setdefault(t, len(self.names)) for t in tokens]
        self.wild[k] = (self.ids[k] == 0).sum()
        self.tokens.append(tokens)
        self.first.append(pos)
        return k


def split(body: Column, delimiters: Sequence[str] = ()) -> Column:
    """Tokens between white space and ``delimiters``."""
    for d in delimiters:
        body = F.replace(body, F.lit(d), F.lit(" "))
    return F.filter(F.split(F.coalesce(body, F.lit("")), r"\s+"), lambda t: t != "")


def leaves(rows: DataFrame, depth: int, children: int = CHILDREN) -> DataFrame:
    """Adds ``n`` and ``path`` to rows (bucket, pos, tokens): the leaf of the tree. Of a node's leading tokens without digits the first by position are kept."""
    rows = rows.withColumn("n", F.size("tokens")).withColumn("path", F.array().cast("array<string>"))
    for level in range(max(depth, LEAST_DEPTH) - UPPER_LEVELS):
        token = F.get("tokens", F.lit(level))
        rows = rows.withColumn("step", F.when(F.col("n") > level + 1, F.when(token.rlike("[0-9]"), WILDCARD).otherwise(token)))
        node = ["bucket", "n", "path"]
        first = rows.filter(F.col("step") != WILDCARD).groupBy(*node, "step").agg(F.min("pos").alias("first"))
        late = first.withColumn("rank", F.row_number().over(Window.partitionBy(*node).orderBy("first"))).filter(F.col("rank") >= children).select(*node, "step", F.lit(True).alias("late"))
        rows = rows.join(late, [*node, "step"], "left")  # empty but for nodes with over a hundred children
        rows = rows.withColumn("path", F.when(F.col("step").isNull(), F.col("path")).otherwise(F.concat("path", F.array(F.when(F.col("late"), WILDCARD).otherwise(F.col("step")))))).drop("step", "late")
    return rows


def assigned(rows: DataFrame, threshold: float, depth: int, delimiters: Sequence[str] = ()) -> DataFrame:
    """pos, body, bucket, cluster (its first position), template (as it stands after the row) of distinct bodies (bucket, pos, body)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, leaf = None, Leaf(0)
        for b in batches:
            out = []
            for bucket, path, pos, text, tokens in zip(b["bucket"], b["path"], b["pos"], b["body"], b["tokens"], strict=True):
                key = (bucket, tuple(path), len(tokens))
                if key != now:
                    now, leaf = key, Leaf(len(tokens))
                i = leaf.add(list(tokens), pos, threshold)
                out.append((pos, text, bucket, leaf.first[i], " ".join(leaf.tokens[i])))
            yield pd.DataFrame(out, columns=["pos", "body", "bucket", "cluster", "template"])

    rows = leaves(rows.withColumn("tokens", split(F.col("body"), delimiters)), depth)
    key = ["bucket", "n", "path"]
    return rows.repartition(*key).sortWithinPartitions(*key, "pos").mapInPandas(run, "pos long, body string, bucket string, cluster long, template string")


def mined(df: DataFrame, position: str, body: str, threshold: float = 0.7, bucket: Sequence[str] = (), depth: int = 4, delimiters: Sequence[str] = ()) -> DataFrame:
    """Template mining: pos, body, template and cluster (by first position) of each row.

    In order of their first position, distinct bodies go to a leaf of the tree (see ``leaves``; depth 3 has token counts only) and join its
    most similar template (equal tokens over length; then, where none is similar enough, counting wildcards as equal), or found one;
    positions in which they differ become the wildcard. Ties go to the template with more wildcards, then to the older. Equal bodies
    of a bucket have one template. Null bodies have no tokens, like empty ones.
    """
    name = F.to_json(F.struct(*bucket)) if bucket else F.lit("")
    rows = df.select(F.col(position).cast("long").alias("pos"), F.col(body).alias("body"), name.alias("bucket"))
    found = assigned(rows.groupBy("bucket", "body").agg(F.min("pos").alias("pos")), threshold, depth, delimiters)
    last = found.groupBy("bucket", F.col("cluster").alias("__c")).agg(F.max_by("template", "pos").alias("template")).withColumnRenamed("bucket", "__b")
    of_body = found.drop("template", "pos").join(last, (F.col("bucket") == F.col("__b")) & (F.col("cluster") == F.col("__c")))
    of_body = of_body.select(F.col("bucket").alias("__b"), F.col("body").alias("__body"), "cluster", "template")
    return rows.join(of_body, (F.col("bucket") == F.col("__b")) & F.col("body").eqNullSafe(F.col("__body"))).select("pos", "body", "template", "cluster")


RUNS = "stream string, __range int, first_pos long, bucket string, tokens array<string>, n long, first_seen long, last_seen long, representative string, goes_on boolean"


def _runs(threshold: float):
    """Runs of ranges, each from the state its rows carry; the first of a range may go on with the run of the range before."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if (row.stream, row.range) != now:
                    if last is not None and last[6]:
                        out.append(last)
                    now = (row.stream, row.range)
                    # bucket and tokens of the run before, without rows yet
                    last = None if row.before_tokens is None else [row.stream, row.range, None, row.before_bucket, list(row.before_tokens), None, 0, None, None, None, True]
                tokens = list(row.tokens)
                if last is not None and last[3] == row.bucket and len(last[4]) == len(tokens):
                    fits = sum(a in (b, WILDCARD) for a, b in zip(last[4], tokens, strict=True))
                    if not tokens or fits >= threshold * len(tokens):
                        last[4] = [a if a == b else WILDCARD for a, b in zip(last[4], tokens, strict=True)]
                        if not last[6]:
                            last[2], last[7], last[8], last[9] = row.pos, row.ts, row.ts, row.body
                        last[6], last[7], last[8] = last[6] + 1, min(last[7], row.ts), max(last[8], row.ts)
                        continue
                if last is not None and last[6]:
                    out.append(last)
                last = [row.stream, row.range, row.pos, row.bucket, tokens, None, 1, row.ts, row.ts, row.body, False]
            yield framed(out)
        if last is not None and last[6]:
            yield framed([last])

    def framed(out: list[list]) -> pd.DataFrame:
        names = ["stream", "__range", "first_pos", "bucket", "tokens", "", "n", "first_seen", "last_seen", "representative", "goes_on"]
        return pd.DataFrame(out, columns=names).drop(columns="")

    return run


def collapsed(df: DataFrame, stream: str, position: str, body: str, ts: str, threshold: float = 0.7, bucket: str | None = None) -> DataFrame:
    """Runs of consecutive rows of a stream (and bucket) whose bodies fit the run's growing template: stream, first_pos, bucket, template, n,
    first_seen, last_seen, representative.

    A body fits if it has as many tokens, and equal tokens and wildcards together are the ``threshold``-th part of them or more. Positions of a
    stream are distinct. Null bodies have no tokens. The result is that of one pass over each stream in order: passes are repeated
    until no range leaves another state than the next one began with, which a range is sure to do once a run begins in it whatever came before.
    """
    rows = df.select(F.col(stream).cast("string").alias("stream"), F.col(position).cast("long").alias("pos"), (F.col(bucket).cast("string") if bucket else F.lit("")).alias("bucket"), F.col(body).alias("body"), F.col(ts).cast("long").alias("ts"))
    rows = ranges.ranged(rows, "pos").withColumn("tokens", split(F.col("body"))).persist()
    state, found, kept = None, None, []
    while True:
        begun = rows if state is not None else rows.withColumns({"before_bucket": F.lit(None).cast("string"), "before_tokens": F.lit(None).cast("array<string>")})
        if state is not None:
            begun = ranges._with(rows, state, ["stream"])
        begun = begun.withColumnRenamed("__range", "range").repartition("stream", "range").sortWithinPartitions("stream", "range", "pos")
        found = begun.mapInPandas(_runs(threshold), RUNS).persist()
        kept.append(found)
        left = found.groupBy("stream", "__range").agg(F.max_by(F.struct("bucket", "tokens"), "first_pos").alias("s"))
        line = Window.partitionBy("stream").orderBy("__range")
        now = left.withColumn("s", F.lag("s").over(line)).select("stream", "__range", F.col("s.bucket").alias("before_bucket"), F.col("s.tokens").alias("before_tokens")).filter("before_tokens is not null")
        changed = now if state is None else now.exceptAll(state)
        if changed.isEmpty():
            break
        state = now.persist()
        kept.append(state)
    begins = ranges.running(found.drop("__range"), ["stream"], ["first_pos"], F.when(F.col("goes_on"), 0).otherwise(1), "run")
    return begins.groupBy("stream", "run").agg(
        F.min("first_pos").alias("first_pos"),
        F.min("bucket").alias("bucket"),
        F.array_join(F.max_by("tokens", "first_pos"), " ").alias("template"),
        F.sum("n").alias("n"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.min_by("representative", "first_pos").alias("representative"),
    ).drop("run")
